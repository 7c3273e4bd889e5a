"""Vector codes against a plain Lloyd on integers, and on odd rows."""

import hashlib
import math

import numpy as np
import pytest

from brindle.llm import codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error int, n int, key int"


def plain(rows, parts, entries, rounds):
    """{(vec_id, vector): (code, error)} and the codebooks, by full scans."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[cut[i][p] for i in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [nearest(c[p], book)[0] for c in cut]
            books[p] = [[sum(c[p][k] for c, o in zip(cut, own) if o == e) // own.count(e) for k in range(width)] if e in own else list(book[e]) for e in range(len(book))]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(i, bytes(e for e, _ in f), sum(d for _, d in f)) for (i, _), f in zip(kept, found)], books


def made(n, dim, seed, grid):
    """Vectors on a coarse grid, so that many distances tie, with copies."""
    rng = np.random.default_rng(seed)
    vectors = (rng.integers(-3, 4, (n, dim)) / grid).astype(np.float32)
    vectors[n // 2 : n // 2 + n // 8] = vectors[0]
    return [(int(i), [float(x) for x in v], int(i) % 3, "x", 0, 0, 0) for i, v in zip(rng.permutation(n), vectors)]


@pytest.mark.parametrize(("dim", "parts", "entries", "rounds", "grid"), [(8, 4, 16, 2, 4), (6, 3, 40, 3, 7), (16, 16, 64, 2, 1), (4, 1, 1, 2, 3)])
def test_codes_equal_plain_lloyd(spark, dim, parts, entries, rounds, grid):
    rows = made(150, dim, dim, grid)
    got, books = codes.quantised(spark.createDataFrame(rows, VECTORS).repartition(3), parts, entries, rounds)
    want, plain_books = plain(rows, parts, entries, rounds)
    assert books.entries.tolist() == plain_books
    assert sorted((r["vec_id"], bytes(r["code"]), r["error"]) for r in got.collect()) == sorted(want)


def test_bounds_spare_distances_and_lose_none():
    rng = np.random.default_rng(5)
    points = rng.integers(-400, 400, (4_000, 4))
    books = codes.first_codebooks(points[:64], 1)
    own, bounds = np.zeros(len(points), dtype=np.int64), np.zeros((len(points), books.farthest.shape[1]), dtype=np.float32)
    spared = []
    for _ in range(4):
        own, square, bounds, computed = codes.assigned(points, books.entries[0], books.members[0], books.farthest[0], own, bounds)
        full = codes.squared(points, books.entries[0])
        assert (own == full.argmin(axis=1)).all() and (square == full.min(axis=1)).all()
        spared.append(1 - computed / full.size)
        sums = np.zeros((1, 64, 4), dtype=np.int64)
        np.add.at(sums[0], own, points)
        books = books.moved(sums, np.bincount(own, minlength=64)[None])
    assert spared[-1] > 0.4


def test_odd_vectors(spark):
    good = [0.5, -0.25, 1.0, 2.0]
    rows = [
        (1, good, None, "x", 0, 0, 0), (1, good, None, "x", 0, 0, 0), (2, None, 1, "x", 0, 0, 0), (3, [0.5, None, 1.0, 2.0], 1, "x", 0, 0, 0), (4, [float("nan")] * 4, 1, "x", 0, 0, 0),
        (5, [float("inf"), 0.0, 0.0, 0.0], 1, "x", 0, 0, 0), (6, [], 1, "x", 0, 0, 0), (7, [0.0] * 4, 1, None, None, None, None), (None, [9.0, 9.0, 9.0, -9.0], 1, "x", 0, 0, 0), (8, [1.0] * 6, 1, "x", 0, 0, 0),
    ]
    got, books = codes.quantised(spark.createDataFrame(rows, VECTORS), 2, 64, 2)
    assert sorted((repr(r["vec_id"]), r["error"]) for r in got.collect()) == [("1", 0), ("1", 0), ("7", 0), ("None", 0)]
    assert books.entries.shape == (2, 4, 2)
    got, books = codes.quantised(spark.createDataFrame([], VECTORS), 2)
    assert got.count() == 0 and books is None
    got, books = codes.quantised(spark.createDataFrame(rows[2:7], VECTORS), 2)
    assert got.count() == 0 and books is None


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = plain(rows, 16, 64, 2)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    label = {i: name for i, _, name in rows}
    total = {}
    for i, _, e in want:
        total[label[i]] = total.get(label[i], 0) + e
    got = sorted(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in codes.op13_codes(spark, sf).collect())
    assert got == sorted((i, code.hex(), e, total[label[i]], sha) for i, code, e in want)
