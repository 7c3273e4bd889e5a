"""The quality classifier: its vectors and votes against plain formulas, and held-out labels."""

import zlib

import numpy as np

from brindle.llm import quality

DOCS = "doc_id long, text string, score string, quality int"
LABELS = "doc_id long, quality int, toxic int"


def test_outlines():
    assert quality.outline(b"The") == b"Aa"
    assert quality.outline(b"and&&&") == b"a&"
    assert quality.outline(b"THE!!") == b"A!"
    assert quality.outline("été".encode()) == b"a"
    assert quality.outline(b"2024-01") == b"9-9"


def test_counts_cover_words_outlines_and_repeats():
    terms, counts = quality.counted(b"go go go\ngo go go")
    found = dict(zip(terms.tolist(), counts.tolist()))
    assert found[quality.term(b"wgo")] == 6 and found[quality.term(b"oa")] == 6
    assert found[quality.term(b"again6")] == 6 and quality.term(b"again7") not in found  # 5 of 6 words
    assert found[quality.term(b"line3")] == 6 and quality.term(b"line4") not in found  # 1 of 2 lines
    for empty in (None, b"", b" \n\t"):
        assert quality.counted(empty)[0].tolist() == [quality.term(b"empty")]


def votes(model, text):
    """The score by its definition: all cosines, the nearest ones, their weights."""
    terms, counts = quality.counted(text)
    v = model.latent([(terms, model._weights(terms, counts))])[0]
    near = [(float(e @ v), y) for e, y in zip(model.examples, model.labels)]
    best = sorted(near, key=lambda x: -x[0])[: quality.NEIGHBOURS]
    w = [max(s, 0.0) ** quality.POWER for s, _ in best]
    return (sum(a * y for a, (_, y) in zip(w, best)) + quality.PRIOR_VOTE * model.prior) / (sum(w) + quality.PRIOR_VOTE)


def test_scores_equal_all_cosines():
    rng = np.random.default_rng(2)
    words = [f"w{i}".encode() for i in range(60)]
    texts = [b" ".join(rng.choice(words[: 40] if i % 2 else words[20:], 30)) for i in range(80)]
    counted = [quality.counted(t) for t in texts]
    n = np.zeros(quality.TERMS)
    for t, _ in counted:
        n[t] += 1
    model = quality.Model(np.log(81 / (n + 1)) + 1, counted, [i % 2 for i in range(80)], 0.5)
    assert model.projection.shape == (quality.TERMS, quality.RANK)
    asked = [*texts[:20], b"", None, b"nothing known here"]
    assert np.allclose(model.scores(asked), [votes(model, t) for t in asked], atol=1e-5)


def test_projection_is_that_of_the_best_subspace():
    counted = [quality.counted(b"a b c d"), quality.counted(b"a b c e"), quality.counted(b"x y z x")]
    model = quality.Model(np.ones(quality.TERMS), counted, [1, 1, 0], 0.5)
    assert np.allclose(model.examples @ model.examples.T, [[x @ y / np.linalg.norm(x) / np.linalg.norm(y) for y in _dense(model, counted)] for x in _dense(model, counted)], atol=1e-5)


def _dense(model, counted):
    out = np.zeros((len(counted), quality.TERMS))
    for row, (t, c) in zip(out, counted):
        row[t] = model._weights(t, c)
    return out


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None, "s", 1), (2, "", "s", 0), (3, "good plain words here", None, None), (3, "good plain words here", None, None), (None, "bad!! bad!!", "s", 1), (4, "w " * 50_000, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (3, 0, 1), (None, 1, 1), (9, None, 0), (77, 1, 0)], LABELS)
    model = quality.fit(docs, marks)
    got = quality.score_documents(docs, model).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == ["1", "2", "3", "3", "4", "None"]
    assert all(0 <= r["score"] <= 1 for r in got)
    none = quality.fit(docs, spark.createDataFrame([], LABELS))
    assert {r["score"] for r in quality.score_documents(docs, none).collect()} == {0.0}
    assert quality.score_documents(spark.createDataFrame([], DOCS), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    want = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality.op12_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [(want[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in want]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
