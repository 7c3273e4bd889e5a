"""Vector codes by product quantisation: Yinyang Lloyd on integer vectors, ties told by exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import looked_up, table, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Entries of a codebook in a group that shares one lower bound, about.
GROUP = 10
#: The largest integer whose squared distances fit a long; larger components end the job with an error.
LARGEST = 1 << 28
#: Vectors a task works on at a time.
ROWS = 2_048

STATE = "vec_id long, label string, vector binary, code binary, error long, bounds binary"


@dataclass
class Codebooks:
    """The entries (part, entry, component) of all parts, the group of each entry, and how far each entry came since the last round."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    def __post_init__(self) -> None:
        self.members = [[np.flatnonzero(own == g) for g in range(self.groups.max(initial=0) + 1)] for own in self.groups]
        #: The farthest that an entry of each group came, by part.
        self.farthest = np.asarray([[d[m].max(initial=0.0) for m in own] for d, own in zip(self.drift, self.members)])

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """The codebooks with each used entry at the floor of its parts' mean."""
        used = counts > 0
        to = self.entries.copy()
        to[used] = sums[used] // counts[used][:, None]
        return Codebooks(to, self.groups, np.sqrt(((to - self.entries).astype(float) ** 2).sum(axis=2)))


def grouped(entries: np.ndarray) -> np.ndarray:
    """The group of each of a codebook's entries, by a few steps of plain clustering of the entries; groups only save work."""
    n = max(1, round(len(entries) / GROUP))
    centres = entries[np.linspace(0, len(entries) - 1, n).astype(int)].astype(float)
    for _ in range(5):
        own = ((entries[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.asarray([entries[own == g].mean(axis=0) if (own == g).any() else c for g, c in enumerate(centres)])
    return own


def first_codebooks(vectors: np.ndarray, parts: int) -> Codebooks:
    """Codebooks of the parts of the given vectors, one entry a vector."""
    entries = vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2).copy()
    return Codebooks(entries, np.asarray([grouped(own) for own in entries]), np.zeros(entries.shape[:2]))


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    out = np.zeros((len(points), len(entries)), dtype=np.int64)
    for c in range(points.shape[1]):
        apart = points[:, c, None] - entries[None, :, c]
        out += apart * apart
    return out


def below(squares: np.ndarray) -> np.ndarray:
    """Single-precision lower bounds of the roots of exact squares."""
    return np.nextafter(np.sqrt(squares.astype(float)).astype(np.float32), np.float32(0))


def assigned(points: np.ndarray, entries: np.ndarray, members: list[np.ndarray], farthest: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, squared distance, bounds, distances computed) of each point of one part, from its last entry and bounds.

    A bound says how near an entry of a group, other than the point's own, can be. It falls by the farthest that
    an entry of the group came; where it is then above the distance to the point's own entry, no entry of the group
    can win or tie. The other groups are scanned with integer distances; of equal ones the smallest index wins.
    """
    rows = np.arange(len(points))
    apart = points - entries[own]
    best = (apart * apart).sum(axis=1)
    upper = np.sqrt(best.astype(float))
    bounds = np.maximum(bounds.astype(float) - farthest, 0.0)
    scan = bounds <= upper[:, None] * (1 + 1e-6) + 1e-6
    # bounds are kept a little below what they say, so that rounding them never makes them say too much
    bounds = np.nextafter((bounds * (1 - 1e-6)).astype(np.float32), np.float32(0))
    last, before = own.copy(), best.copy()
    held = np.zeros(len(entries), dtype=np.int64)
    computed, scanned = len(points), []
    for g, m in enumerate(members):
        held[m] = g
        at = np.flatnonzero(scan[:, g])
        if not len(at) or not len(m):
            continue
        d = squared(points[at], entries[m])
        computed += d.size
        near = d.argmin(axis=1)
        least = d[np.arange(len(at)), near]
        index = m[near]
        d[np.arange(len(at)), near] = np.iinfo(np.int64).max
        scanned.append((g, at, index, least, d.min(axis=1)))
        wins = (least < best[at]) | ((least == best[at]) & (index < own[at]))
        own[at[wins]], best[at[wins]] = index[wins], least[wins]
    for g, at, index, least, second in scanned:
        bounds[at, g] = below(np.where(index == own[at], second, least))
    # the entry a point has left is another one of its group now
    left = np.flatnonzero(own != last)
    bounds[rows[left], held[last[left]]] = np.minimum(bounds[rows[left], held[last[left]]], below(before[left]))
    return own, best, bounds, computed


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vector binary of little-endian longs) of the rows whose vector has only finite components, one at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes nan
            ends = np.cumsum(lengths)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = np.flatnonzero((lengths > 0) & (wrong[ends] == wrong[ends - lengths]))
            scaled = np.floor(np.where(np.isfinite(flat), flat, 0.0) * SCALE)
            data, dims = [], []
            for i in good.tolist():
                v = scaled[ends[i] - lengths[i] : ends[i]]
                if np.abs(v).max() > LARGEST:
                    raise ValueError(f"vector components beyond {LARGEST / SCALE:.0f} have no code")
                data.append(v.astype("<i8").tobytes())
                dims.append(len(v))
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(take), batch.column("label").take(take), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "label", "dim", "vector"]
            )

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label string, dim int, vector binary")


def _parts(data: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), dtype="<i8").reshape(len(data), parts, -1)


def _assign(state: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    """The state of each vector with these codebooks; without a code before, its bounds are 0 and all groups are scanned."""
    sent = state.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        groups = books.farthest.shape[1]
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                points, n = _parts(batch.column("vector"), parts), batch.num_rows
                if batch.column("code").null_count:
                    own, bounds = np.zeros((n, parts), dtype=np.uint8), np.zeros((n, parts, groups), dtype=np.float32)
                else:
                    own = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(n, parts).copy()
                    bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), dtype=np.float32).reshape(n, parts, groups).copy()
                error = np.zeros(n, dtype=np.int64)
                for p in range(parts):
                    entry, square, bounds[:, p], _ = assigned(points[:, p], books.entries[p], books.members[p], books.farthest[p], own[:, p].astype(np.int64), bounds[:, p])
                    own[:, p] = entry
                    error += square
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id"), batch.column("label"), batch.column("vector"), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(error, pa.int64()),
                        pa.array([x.tobytes() for x in bounds], pa.binary()),
                    ],
                    ["vec_id", "label", "vector", "code", "error", "bounds"],
                )

    return state.select("vec_id", "label", "vector", "code", "error", "bounds").mapInArrow(run, STATE)


def _sums(state: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and counts of the parts of each entry; a task sends one row a sum, whatever its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            points = _parts(batch.column("vector"), parts)
            own = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(total[p, :, :width], own[:, p], points[:, p])
                total[p, :, width] += np.bincount(own[:, p], minlength=entries)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], ["place", "total"])

    found = state.select("vector", "code").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(parts * entries * (width + 1), dtype=np.int64)
    out[found.column("place").to_numpy()] = found.column("total").to_numpy()
    out = out.reshape(parts, entries, width + 1)
    return out[..., :width], out[..., width]


def quantised(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, code, error) of every kept vector, the final codebooks); code has a byte a part, error sums the squared distances.

    Dropped are vectors that are null, empty or hold null or non-finite components, and those of another length than the
    vector of the smallest vec_id among those whose length ``parts`` divides. Codebooks start as the parts of the ``entries``
    smallest vec_ids (ties by the vector's bytes, null ids last), or of all if there are fewer; at most 256 entries. Each
    round assigns and moves the entries; a last assignment follows. Each round's codes and bounds are a written table, so a
    lost executor costs its tasks only; what the driver holds are codebooks. Rows of equal vec_id come out each; an
    empty table gives no rows and no codebooks; extra columns are ignored.
    """
    spark = vectors.sparkSession
    kept = _valid(vectors).where(F.col("dim") % parts == 0)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("dim").first()
    if first is None:
        return spark.createDataFrame([], "vec_id long, label string, code binary, error long"), None
    dim = first["dim"]
    kept = kept.where(F.col("dim") == dim)
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    books = first_codebooks(np.stack([np.frombuffer(r["vector"], dtype="<i8") for r in seeds]), parts)
    none = F.lit(None)
    state = kept.withColumns({"code": none.cast("binary"), "error": none.cast("long"), "bounds": none.cast("binary")})
    for _ in range(rounds):
        state = written(_assign(state, books, parts), "codes")
        books = books.moved(*_sums(state, parts, len(seeds), dim // parts))
    return written(_assign(state, books, parts).drop("vector", "bounds"), "codes"), books


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = quantised(table(spark, sf_dir, "embeddings"))
    numbers = ",".join(map(str, books.entries.ravel().tolist())) if books else ""
    # a null label is a key like others
    keyed = codes.withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null")))
    sums = written(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label_errors")
    out = looked_up(keyed, sums, "key", "n")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))
