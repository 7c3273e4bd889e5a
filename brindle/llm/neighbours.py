"""Embedding near-duplicates by an inverted multi-index: codebooks on vector halves, cells visited nearest first, links verified."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import components, table, written

#: Vectors the codebooks are fitted on, at most, and those of them the number of visited cells is measured on.
SAMPLE, PROBES = 20_000, 1_000
#: Vectors of one label that a cell of the grid should hold; codewords of a half, at most.
OCCUPANCY, CODEWORDS = 256, 512
#: Share of neighbours just at the threshold that the visited cells must hold.
RECALL = 0.98
#: Cells of a grid that every search visits all of.
FEW = 9
#: Rows of a cell that meet in one task at a time: searching and held ones.
QUERIES, ENTRIES = 2_048, 512


def kmeans(data: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k codewords (fewer if there are fewer vectors) by Lloyd's rounds from evenly spaced rows."""
    words = np.unique(data[np.linspace(0, len(data) - 1, min(k, len(data))).astype(int)], axis=0)
    for _ in range(rounds):
        near = distances(data, words).argmin(axis=1)
        sums = np.zeros_like(words)
        np.add.at(sums, near, data)
        n = np.bincount(near, minlength=len(words))[:, None]
        words = np.where(n > 0, sums / np.maximum(n, 1), words)
    return words


def distances(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((data**2).sum(axis=1)[:, None] - 2 * data @ words.T + (words**2).sum(axis=1), 0)


def multi_sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cells (i, j) of the product grid by a[i] + b[j], least first."""
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen = [(a[order_a[0]] + b[order_b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, x, y = heapq.heappop(heap)
        yield int(order_a[x]), int(order_b[y])
        for u, v in ((x + 1, y), (x, y + 1)):
            if u < len(a) and v < len(b) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (a[order_a[u]] + b[order_b[v]], u, v))


class MultiIndex:
    """Codebooks of the two halves of unit vectors, and how many cells a search visits."""

    def __init__(self, sample: np.ndarray, codewords: int, threshold: float):
        self.half = sample.shape[1] // 2
        self.books = kmeans(sample[:, : self.half], codewords), kmeans(sample[:, self.half :], codewords)
        self.visits = self._visits(sample, threshold)

    def parts(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(unit[:, : self.half], self.books[0]), distances(unit[:, self.half :], self.books[1])

    def _visits(self, sample: np.ndarray, threshold: float) -> int:
        """Measured on probes of the sample: the rank of the cells of their neighbours in it, and of vectors turned
        away just to the threshold in random directions; the larger number. All of a grid of few cells."""
        cells = len(self.books[0]) * len(self.books[1])
        if cells <= FEW:
            return cells
        rng = np.random.default_rng(3)
        x = sample[np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(int)]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1)[:, None] * x
        away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * away
        probe, other = np.nonzero(x @ sample.T >= threshold)
        apart = np.abs(x[probe] - sample[other]).max(axis=1) > 0
        probe, other = (v[apart][:: max(1, int(apart.sum()) // (4 * PROBES))] for v in (probe, other))
        most = self._rank(x, y)
        return max(most, self._rank(x[probe], sample[other]) if len(probe) else 0)

    def _rank(self, x: np.ndarray, y: np.ndarray) -> int:
        """How many cells from x on must be visited until that of y is among them, for ``RECALL`` of the pairs."""
        (a, b), (ya, yb) = self.parts(x), self.parts(y)
        rows = np.arange(len(x))
        at = a[rows, ya.argmin(axis=1)] + b[rows, yb.argmin(axis=1)]
        ranks = [int(sum(np.searchsorted(sb, s - v, side="left") for v in va)) for va, sb, s in zip(a, np.sort(b, axis=1), at)]
        return int(np.quantile(ranks, RECALL, method="higher")) + 1

    def cells(self, unit: np.ndarray) -> list[list[int]]:
        """The cells each vector visits, nearest first; the first is where it is held."""
        width = len(self.books[1])
        out = []
        for a, b in zip(*self.parts(unit)):
            walk = multi_sequence(a, b)
            out.append([i * width + j for _, (i, j) in zip(range(self.visits), walk)])
        return out


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, key, vector binary) of every row; key is null where it can't link: not finite, zero, or without label or id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys, data = [], [], []
            for x in batch.column("embedding").to_pylist():
                v = None if x is None or not x or any(c is None for c in x) else np.asarray(x, dtype="<f8")
                ok = v is not None and bool(np.isfinite(v).all()) and bool(v.any())
                dims.append(len(v) if ok else None)
                data.append(v.tobytes() if ok else None)
                keys.append(xxhash.xxh3_128_digest(v.tobytes()) if ok else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "label", "dim", "key", "vector"]
            )

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    out = rows.mapInArrow(run, "vec_id long, label long, dim int, key binary, vector binary")
    return out.withColumn("key", F.expr("CASE WHEN label IS NOT NULL AND vec_id IS NOT NULL THEN key END"))


def _units(data: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to ``dim`` components."""
    out = np.zeros((len(data), dim))
    for i, x in enumerate(data):
        v = np.frombuffer(x, dtype="<f8")
        v = v / np.abs(v).max()
        out[i, : len(v)] = v / np.linalg.norm(v)
    return out


def _joined(q: np.ndarray, e: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id each row of q and e reaches over the links ``at``; a vector among both is one node."""
    nodes, inverse = np.unique(np.concatenate([q, e]), return_inverse=True)
    a, b = inverse[: len(q)][at[0]], inverse[len(q) :][at[1]]
    least = np.arange(len(nodes))
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            found = nodes[least]
            return found[inverse[: len(q)]], found[inverse[len(q) :]]
        least = new


def link_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; vectors of one label link at a cosine of ``threshold`` or more.

    Equal vectors of a label are one node, of the smallest vec_id, with a count. Each node is held in one cell of
    the grid and visits the nearest cells until the measured target recall; those it meets are verified in
    double precision. Searching and held rows of a large cell meet in blocks, so tasks stay bounded. Null,
    zero, empty or non-finite vectors, null labels and null ids link with nothing, and so do vectors
    of different lengths. Repeated vec_ids count as other vectors. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(_valid(vectors), "vectors")
    valid = rows.where("key IS NOT NULL")
    nodes = written(valid.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "nodes")
    size = nodes.agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.count_distinct("label").alias("labels")).first()
    if size["n"]:
        dim = size["dim"] + size["dim"] % 2
        sample = _units([r["vector"] for r in nodes.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").collect()], dim)
        cells = size["n"] / size["labels"] / OCCUPANCY
        sent = spark.sparkContext.broadcast(MultiIndex(sample, int(min(CODEWORDS, max(1, np.ceil(np.sqrt(cells))))), threshold))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = sent.value.cells(_units(batch.column("vector").to_pylist(), dim))
                kept = [batch.column(c) for c in ("id", "label", "dim", "copies", "vector")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int32()))], ["id", "label", "dim", "copies", "vector", "cells"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for row in batch.column("own").to_pylist():
                    q, e = [r for r in row if r["searching"]], [r for r in row if not r["searching"]]
                    if not q or not e:
                        continue
                    qi, ei = np.asarray([r["id"] for r in q]), np.asarray([r["id"] for r in e])
                    found = (_units([r["vector"] for r in q], dim) @ _units([r["vector"] for r in e], dim).T >= threshold) & (qi[:, None] != ei)
                    at = np.nonzero(found)
                    if not len(at[0]):
                        continue
                    qn, en = np.asarray([r["copies"] for r in q]), np.asarray([r["copies"] for r in e])
                    qs, es = np.zeros(len(q), np.int64), np.zeros(len(e), np.int64)
                    np.add.at(qs, at[0], en[at[1]])
                    visits = [set(r["cells"]) for r in e]
                    alone = np.asarray([q[i]["cells"][0] not in visits[j] for i, j in zip(*at)])  # the held one never meets it itself
                    np.add.at(es, at[1][alone], qn[at[0][alone]])
                    ql, el = _joined(qi, ei, at)
                    for ids, n, least in ((qi, qs, ql), (ei, es, el)):
                        some = (n > 0) | (least != ids)
                        out.append((ids[some], n[some], least[some]))
                columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "n", "least"])

        kinds = "id long, label long, dim int, copies long, vector binary, cells array<int>"
        placed = written(nodes.select("id", "label", "dim", "copies", "vector").mapInArrow(place, kinds), "placed")
        held = placed.withColumn("cell", F.col("cells")[0])
        searching = placed.withColumn("cell", F.explode("cells"))
        key = ["label", "dim", "cell"]
        blocks = held.groupBy(*key).agg(F.ceil(F.count("*") / ENTRIES).cast("int").alias("e")).join(searching.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q")), key)

        def dealt(rows: DataFrame, own: str, other: str, kind: bool) -> DataFrame:
            put = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(f"{own}_at")
            every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at")
            row = F.struct(F.lit(kind).alias("searching"), "id", "copies", "vector", F.slice("cells", 1, 1).alias("cells") if kind else F.col("cells"))
            return rows.join(blocks, key).select(*key, put, every, row.alias("row")).select(*key, "q_at", "e_at", "row")

        met = dealt(searching, "q", "e", True).unionByName(dealt(held, "e", "q", False)).groupBy(*key, "q_at", "e_at").agg(F.collect_list("row").alias("own"))
        found = written(met.select("own").mapInArrow(meet, "id long, n long, least long"), "found")
    else:
        found = spark.createDataFrame([], "id long, n long, least long")
    counted = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    of_node = (
        nodes.select("label", "dim", "key", "id", "copies").join(counted, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select("label", "dim", "key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component"))
    )
    linked = valid.select("vec_id", "label", "dim", "key").join(of_node, ["label", "dim", "key"]).select("vec_id", "n", "component")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    return linked.unionByName(alone).select(
        "vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept")
    )


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"), 0.93)
