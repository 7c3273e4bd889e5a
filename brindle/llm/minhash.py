"""Near-duplicates by one-permutation hashing, optimal densification, banded buckets and star-shaped candidates."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import claim, components, looked_up, table, written

WORDS = 5
#: Bins of a signature; the most a pair at the threshold may be missed by all bands.
BINS, MISS = 256, 1e-5
#: Bins of the sketches by which members of a bucket that stars left apart are compared, and of their first look.
SKETCH = 1_024
#: Members of a bucket that are compared within one task at a time.
BLOCK = 512
#: Rows that are broadcast to say which rows go; more are joined by a shuffle.
MARKS = 2_000_000
#: Word hashes a worker keeps.
CACHE = 150_000

_U = np.uint64
_ODD = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=_U)
_MIX = np.random.default_rng(11).integers(0, 2**63, BINS, dtype=np.int64).astype(_U) * _U(2) + _U(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()


def claim_hashes() -> None:
    claim("minhash", _hashes.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's shingles; with fewer words the whole sequence is one; without any none.

    Only A-Z are lower-cased and only space and \\t to \\r part words: what ``bytes.lower`` and ``bytes.split`` do.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=_U)
    h = np.fromiter(map(_hashes.__getitem__, parts), dtype=_U, count=len(parts))
    k = min(words, len(parts))
    n = len(parts) - k + 1
    total = np.full(n, k, dtype=_U)
    for i in range(k):
        total += h[i : i + n] * _ODD[i % 5] * _U(2 * (i // 5) + 1)
    return np.unique(_mixed(total))


@cache
def _probes(bins: int) -> np.ndarray:
    """For each bin all bins in a random order of its own."""
    return np.argsort(np.random.default_rng(bins).random((bins, bins)), axis=1).astype(np.int16)


def signature(own: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One permutation: the least hash in each of ``bins`` ranges; an empty bin takes that of the first full bin in its own random order."""
    first = np.searchsorted(own, np.arange(bins, dtype=_U) << _U(65 - bins.bit_length()))
    full = first < np.append(first[1:], len(own))
    found = own[np.minimum(first, len(own) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        probes = _probes(bins)[empty]
        found[empty] = found[probes[np.arange(len(empty)), np.argmax(full[probes], axis=1)]]
    return found


def least_estimate(threshold: float, bins: int) -> float:
    """Five standard deviations below ``threshold`` in an estimate from ``bins`` bins."""
    return threshold - 5 * (threshold * (1 - threshold) / bins) ** 0.5


def rows_per_band(threshold: float) -> int:
    """The most rows with which a pair at ``threshold`` shares no band with a probability of at most ``MISS``."""
    return max((r for r in range(1, 17) if (1 - threshold**r) ** (BINS // r) <= MISS), default=1)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n = BINS // rows
    keys = (sig[: n * rows] * _MIX[: n * rows]).reshape(n, rows).sum(axis=1, dtype=_U)
    return _mixed(keys + np.arange(n, dtype=_U) * _ODD[0]).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on full sets."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, digest, n_shingles, key, bands): digest is of the text, key tells sets apart, bands are bucket numbers. Null for empty sets."""
    rows = rows_per_band(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_hashes()
        for batch in batches:
            n, keys, bands = [], [], []
            for text in batch.column(2):
                own = shingles(text.as_py())
                n.append(len(own))
                if len(own):
                    keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                    bands.append(band_keys(signature(own), rows))
                else:
                    keys.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "digest", "n_shingles", "key", "bands"],
            )

    return _identified(docs).mapInArrow(run, "doc_id long, digest long, n_shingles long, key binary, bands array<long>")


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on the full sets of their texts (id, text); hot ids are split by AQE's skewed joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_hashes()
        held: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            a, b, text_a, text_b = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
            keep = []
            for i, x in enumerate(a.to_pylist()):
                if x not in held:
                    held[x] = shingles(text_a[i].as_py())
                    if len(held) > 64:
                        held.popitem(last=False)
                keep.append(similar(held[x], shingles(text_b[i].as_py()), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def sketches(texts: DataFrame) -> DataFrame:
    """(id, n_shingles, sketch) of texts (id, text): a byte a bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_hashes()
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            data = [(signature(own, SKETCH) & _U(255)).astype(np.uint8).tobytes() for own in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(own) for own in sets], pa.int64()), pa.array(data, pa.binary())], ["id", "n_shingles", "sketch"])

    return texts.select("id", "text").mapInArrow(run, "id long, n_shingles long, sketch binary")


def residual_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components within a bucket that their sketches can't rule out.

    ``members``: (bucket, size, minors, minor, id, component, n_shingles, bands, sketch); minor are those outside
    the bucket's largest component, and ``minors`` is how many there are. Only they need be compared with the others. A pair
    is looked at in the first bucket it shares; where that one isn't among ``members``, a star or its component
    has settled the pair. Minor ones and all are dealt into blocks of ``BLOCK`` that meet one by one, so
    a task holds two blocks, whatever the bucket.
    """
    looks = [(n, least_estimate(percent / 100, n)) for n in (BINS, SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a: list[int] = []
            out_b: list[int] = []
            for bucket, row in zip(batch.column("bucket").to_pylist(), batch.column("own").to_pylist()):
                bands = np.asarray([m["bands"] for m in row], dtype=np.int64)
                ids, comp, n = (np.asarray([m[c] for m in row], dtype=np.int64) for c in ("id", "component", "n_shingles"))
                sketch = np.frombuffer(b"".join(m["sketch"] for m in row), dtype=np.uint8).reshape(-1, SKETCH)
                asking = np.asarray([m["asking"] for m in row])
                every = np.flatnonzero(~asking)
                for x in np.flatnonzero(asking):
                    others = every[(comp[every] != comp[x]) & (100 * np.minimum(n[every], n[x]) >= percent * np.maximum(n[every], n[x]))]
                    same = bands[others] == bands[x]
                    others = others[bands[x][np.argmax(same, axis=1)] == bucket]
                    for bins, least in looks:
                        others = others[(sketch[others, :bins] == sketch[x, :bins]).mean(axis=1) >= least]
                    out_a += np.minimum(ids[others], ids[x]).tolist()
                    out_b += np.maximum(ids[others], ids[x]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    rows, columns = F.ceil(F.col("minors") / BLOCK).cast("int"), F.ceil(F.col("size") / BLOCK).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    put = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    own = lambda asking: F.struct(F.lit(asking).alias("asking"), "id", "component", "n_shingles", "bands", "sketch").alias("own")
    asking = members.where("minor").select("bucket", put(rows).alias("x"), every(columns).alias("y"), own(True))
    asked = members.select("bucket", every(rows).alias("x"), put(columns).alias("y"), own(False))
    met = asking.unionByName(asked).groupBy("bucket", "x", "y").agg(F.collect_list("own").alias("own"))
    return met.select("bucket", "own").mapInArrow(run, "a long, b long").distinct()


def placed(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, digest, n_shingles, found, chosen) of every row: found and chosen are doc_id and text digest of its component's least row.

    Rows are linked whose texts' shingle sets are similar by ``percent``; found is null where a row is no node.

    Equal sets are one node, known by a hash of the set. In each bucket of a band the node with most company is
    the hub, and each other node is a candidate of the hub only (a star). Links are confirmed on full
    sets and joined to components. Where a bucket still holds several components, its members
    are compared by sketches in blocks and what may be a link is confirmed too, so stars lose none. Large buckets
    meet their hub in parts of ``BLOCK`` nodes; a text with very many copies and a very large component are looked up by broadcast.
    Null and empty texts have no shingles and are linked with nothing; a null doc_id is no node. A repeated doc_id
    with another text is another node. An empty table gives no rows; extra columns are ignored; repeated rows come out repeated.
    """
    sig = written(signatures(docs, percent), "signatures")
    first_of = F.min(F.struct("doc_id", "digest"))
    nodes = sig.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(first_of.alias("first"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = written(nodes.select("key", F.xxhash64("key").alias("id"), "first.doc_id", "first.digest", "bands", "copies"), "nodes")
    buckets = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(buckets.join(shared, "bucket"), "members")
    company = members.groupBy("id").agg(F.sum("size").alias("company"))
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    every_part = F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    hubs = members.join(company, "id").groupBy("bucket").agg(F.min(F.struct((-F.col("company")).alias("company"), "id"))["id"].alias("hub"), F.max("size").alias("size"))
    in_parts = members.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    starred = written(in_parts.join(hubs.select("bucket", "hub", every_part), ["bucket", "part"]), "starred")
    linked = nodes.join(company.select("id"), "id", "left_semi").select("id", "doc_id", "digest")
    texts = written(_identified(docs).join(linked, ["doc_id", "digest"]).select("id", "text").dropDuplicates(["id"]), "texts")
    stars = starred.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = written(confirm(stars, texts, percent), "links")
    first = components(links)
    # what the stars can't tell: members of one bucket, the hub aside, that are in different components
    placed = starred.where("size > 2 AND id <> hub").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    held = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    mixed = held.groupBy("bucket").agg(F.count("*").alias("components"), F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("size").alias("size")).where("components > 1")
    mixed = mixed.select("bucket", F.col("main.component").alias("main"), (F.col("n") - F.col("main.n")).alias("minors"), every_part)
    rest = placed.join(mixed, ["bucket", "part"]).select("bucket", "size", "minors", (F.col("component") != F.col("main")).alias("minor"), "id", "component")
    rest = written(rest, "rest")
    rest = rest.join(nodes.select("id", "bands"), "id").join(sketches(texts.join(rest.select("id"), "id", "left_semi")), "id")
    candidates = residual_pairs(rest, percent)
    candidates = written(candidates.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti"), "candidates")
    more = written(confirm(candidates, texts, percent), "more")
    final = first if more.isEmpty() else components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    in_component = written(nodes.select("key", "id", "doc_id", "digest", "copies").join(final.withColumnRenamed("node", "id"), "id").drop("id"), "in_component")
    least = in_component.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count("*").alias("n"))
    least = written(least.select("component", F.col("first.doc_id").alias("found"), F.col("first.digest").alias("chosen"), "n"), "least")
    of_key = looked_up(in_component.select("key", "component", "copies"), least, "component", "n").select("key", "found", "chosen", "copies")
    alone = nodes.join(in_component, "key", "left_anti").select("key", F.col("doc_id").alias("found"), F.col("digest").alias("chosen"), "copies")
    of_key = written(of_key.unionByName(alone), "of_key")
    return looked_up(sig.select("doc_id", "digest", "n_shingles", "key"), of_key, "key", "copies").drop("key")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row, as ``placed`` links them; a row that is no node is its own component.

    A repeated doc_id with another text has the same id in another component.
    """
    component = F.coalesce("found", "doc_id")
    return placed(docs, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: of each component one row stays, of the smallest doc_id, then text digest.

    Rows are told by doc_id and text, so of a repeated doc_id each text has its own place, and of repeated rows one stays.
    Rows without shingles or doc_id are linked with nothing and all stay. Texts aren't shuffled for up to ``MARKS`` rows to drop.
    """
    own = F.struct("doc_id", "digest").eqNullSafe(F.struct(F.col("found").alias("doc_id"), F.col("chosen").alias("digest")))
    rows = placed(docs, percent).where("found IS NOT NULL").groupBy(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"))
    marks = written(rows.agg(F.first(own).alias("_stays"), F.count("*").alias("_n")).where("NOT _stays OR _n > 1").drop("_n"), "marks")
    sent = F.broadcast(marks) if marks.count() <= MARKS else marks
    told = docs.withColumns({"_doc": F.col("doc_id").cast("long"), "_digest": F.xxhash64("text")}).join(sent, ["_doc", "_digest"], "left")
    if marks.where("_stays").isEmpty():
        return told.where("_stays IS NULL").select(*docs.columns)
    once = told.where("_stays").dropDuplicates(["_doc", "_digest"])
    return told.where("_stays IS NULL").unionByName(once).select(*docs.columns)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)
