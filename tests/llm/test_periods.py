"""Periodic runs against brute force, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from brindle.llm import periods

DOCS = "doc_id long, text string, runs string, collapsed int"


def brute(words):
    """Every run, by trying all periods from all places."""
    out = set()
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if end > at and length >= max(6, 4 * q):
                own = words[at : at + length]
                if not any(own[r:] == own[:-r] for r in range(1, q)):
                    out.add((at, length, q))
            at = max(end, at + 1)
    return sorted(out)


def sequences():
    rng = random.Random(7)
    for _ in range(1_500):
        letters, n, words = rng.choice([1, 2, 2, 3, 5]), rng.randrange(0, 260), []
        while len(words) < n:
            if rng.random() < 0.6:
                part = [rng.randrange(letters) for _ in range(rng.choice([1, 1, 2, 3, rng.randrange(1, 40)]))]
                words += (part * rng.randrange(1, 40))[: rng.randrange(1, 120)]
            else:
                words += [rng.randrange(letters + 3) for _ in range(rng.randrange(1, 6))]
        yield words[:n]


def nested():
    """Runs of runs: stretches of one word, of several lengths, that recur with a longer period."""
    rng = random.Random(8)
    for _ in range(300):
        block = []
        while len(block) < rng.randrange(4, 60):
            block += [rng.randrange(2)] * rng.choice([1, 2, 9, 17, 33])
        head, tail = ([rng.randrange(3) for _ in range(rng.randrange(0, 20))] for _ in range(2))
        yield head + block * rng.randrange(3, 8) + tail


def test_runs_equal_brute_force():
    for words in [*sequences(), *nested()]:
        assert periods.find_runs(np.asarray(words, dtype=np.int64)) == brute(words), words


def test_every_period_has_one_block_size():
    sizes = [periods.periods_of(2**k) for k in range(1, 16)]
    assert sizes[0][0] == 1
    for (_, last), (first, _) in zip(sizes, sizes[1:]):
        assert first == last + 1


def test_long_texts_of_one_word_and_of_long_periods():
    rng = np.random.default_rng(3)
    for q in (1, 2, 700, 9_000):
        words = np.concatenate([rng.integers(0, 90, 500), np.tile(rng.integers(100, 5_000, q), -(-40_000 // q))[:40_000], rng.integers(0, 90, 500)])
        assert (500, 40_000, q) in periods.find_runs(words)


def rows_of(df):
    from brindle.llm.periods import periodic_runs

    return {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(df).collect()}


def test_texts_and_odd_rows(spark):
    text = "so " + "la la la " * 4 + "end word x"
    many = "a b " * 30_000
    rows = [(1, text, "r", 1), (2, None, "r", 1), (3, "", "r", 1), (4, " \n\t", "r", 1), (None, "no no no no no no", "r", 1), (5, many, None, None), (6, "A a A a A a", None, None)]
    got = rows_of(spark.createDataFrame(rows, DOCS))
    assert got[1] == (15, [(1, 12, 1)], "so la end word x")
    assert got[2] == got[3] == got[4] == (0, [], "")
    assert got[None] == (6, [(0, 6, 1)], "no")
    assert got[5] == (60_000, [(0, 60_000, 2)], "a b")
    assert got[6] == (6, [], "A a A a A a")
    assert periods.periodic_runs(spark.createDataFrame(rows + rows, DOCS)).count() == 14
    assert periods.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in periods.op11_periods(spark, sf).collect()}
    assert len(got) == len(docs)
    looped = 0
    for d in docs:
        words = (d["text"] or "").encode().split()
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            looped += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        r = got[d["doc_id"]]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
    assert looped > 5
