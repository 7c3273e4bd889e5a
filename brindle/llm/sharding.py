"""Sharding by Karmarkar-Karp differencing: indivisible groups to shards of near-equal bytes."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import partitions, ranked, table, text_or_empty, written

#: Groups over 1 / (SHARE * shards) of all bytes are placed as they are; so there are at most SHARE * shards of them.
SHARE = 8
#: Groups differenced at once within a task; what a step leaves is differenced with the next step's.
CHUNK = 10_000
#: Parts of each kind a task makes of its groups, for each shard; parts of all tasks, at most, unless there are more tasks.
PARTS, ALL_PARTS = 4, 50_000
#: How much of a task's bytes, from its largest groups on, goes to large parts, and to large and middle ones; the rest goes to small ones.
SCALES = (0.75, 0.95, 1.0)


def differencing(partials: Iterable[tuple[list[int], list]], k: int) -> tuple[list[int], list]:
    """Combines partial partitions (k sums, k contents) into one by largest differencing.

    The two of largest spread are added in opposite order again and again. A content is None, a
    leaf, or a pair of contents. No partials: k empty parts.
    """
    heap = []
    for i, (sums, what) in enumerate(partials):
        order = sorted(range(k), key=lambda j: -sums[j])
        s = [sums[j] for j in order]
        heap.append((s[-1] - s[0], i, s, [what[j] for j in order]))
    if not heap:
        return [0] * k, [None] * k
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, s1, w1 = heapq.heappop(heap)
        _, _, s2, w2 = heapq.heappop(heap)
        new = [(a + b, (x, y) if x is not None and y is not None else x if y is None else y) for a, b, x, y in zip(s1, reversed(s2), w1, reversed(w2))]
        new.sort(key=lambda p: -p[0])
        s = [p[0] for p in new]
        heapq.heappush(heap, (s[-1] - s[0], n, s, [p[1] for p in new]))
        n += 1
    return heap[0][2], heap[0][3]


def leaves(content) -> Iterator:
    """The leaves of a content: anything that is neither None nor a pair."""
    stack = [content]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        elif x is not None:
            yield x


def single(weight: int, leaf, k: int) -> tuple[list[int], list]:
    return [weight] + [0] * (k - 1), [leaf] + [None] * (k - 1)


def _deal(parts: int):
    """Arrow mapper: groups (key, w) of a task to ``parts`` bins of near-equal sums for each of ``SCALES``.

    The small parts hold the smallest groups: they level what the large ones leave.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held: list[tuple[int, list, list[int], list[int]]] = []
        sums: list[list[list[int]]] = [[] for _ in SCALES]
        for batch in batches:
            rows = list(zip(batch.column("w").to_pylist(), batch.column("key").to_pylist()))
            for at in range(0, len(rows), CHUNK):
                own = sorted(rows[at : at + CHUNK], reverse=True)
                total, before, kinds = sum(w for w, _ in own), 0, [[] for _ in SCALES]
                for w, key in own:
                    kinds[next(i for i, share in enumerate(SCALES) if before < share * total or share == 1.0)].append((w, key))
                    before += w
                for kind, some in enumerate(kinds):
                    part_sums, found = differencing((single(w, [i], parts) for i, (w, _) in enumerate(some)), parts)
                    bins = [0] * len(some)
                    for j, content in enumerate(found):
                        for (i,) in leaves(content):
                            bins[i] = j
                    held.append((kind, [key for _, key in some], bins, [w for w, _ in some]))
                    sums[kind].append(part_sums)
        # the bins of all chunks are differenced in turn
        place = []
        for own in sums:
            to_bin = [[0] * parts for _ in own]
            _, found = differencing([(s, [[(c, j)] for j in range(parts)]) for c, s in enumerate(own)], parts)
            for to, content in enumerate(found):
                for ((c, j),) in leaves(content):
                    to_bin[c][j] = to
            place.append(iter(to_bin))
        for kind, ks, bins, ws in held:
            to_bin = next(place[kind])
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array(ks, pa.string()), "pid": pa.array([pid] * len(ks), pa.int32()), "bin": pa.array([kind * parts + to_bin[b] for b in bins], pa.int32()), "w": pa.array(ws, pa.int64())}
            )

    return run


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(key string, w long) to (key, shard): each key whole in one shard, sums of w as equal as it can be.

    Every task differences its own groups to parts; the driver differences the sums of all parts and the at most
    ``SHARE * shards`` heavy groups to shards, whatever their sizes. It sees ``ALL_PARTS`` sums at most, or one a task if
    there are more tasks. ``groups`` should be a written table with unique keys. No groups give no rows.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("w")).first()[0] or 0
    limit = max(1, total // (SHARE * shards))
    heavy = [(r["key"], r["w"]) for r in groups.where(F.col("w") > limit).collect()]
    tasks = partitions(spark)
    parts = max(1, min(PARTS * shards, ALL_PARTS // (len(SCALES) * tasks)))
    dealt = groups.where(F.col("w") <= limit).select("key", "w").repartition(tasks, "key").mapInArrow(_deal(parts), "key string, pid int, bin int, w long")
    dealt = written(dealt, "shards")
    sums = [(r["w"], (r["pid"], r["bin"])) for r in dealt.groupBy("pid", "bin").agg(F.sum("w").alias("w")).orderBy("pid", "bin").collect()]
    _, found = differencing((single(w, [what], shards) for w, what in [*((w, (-1, key)) for key, w in sorted(heavy)), *sums]), shards)
    placed = [(pid, what, shard) for shard, content in enumerate(found) for ((pid, what),) in leaves(content)]
    where = spark.createDataFrame([x for x in placed if x[0] >= 0], "pid int, bin int, shard int")
    own = dealt.join(F.broadcast(where), ["pid", "bin"]).select("key", "shard")
    return own.unionByName(spark.createDataFrame([(key, shard) for pid, key, shard in placed if pid < 0], "key string, shard int"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """All documents to ``shards`` shards of near-equal bytes; equal texts stay together.

    Size is the UTF-8 length plus 8; null texts count as empty and go with the empty ones. Returns
    doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard). Repeated rows keep a slot
    each; null doc_ids are kept. Extra columns are ignored. A group heavier than a fair share leaves
    its shard heavier, and the others are levelled around it.
    """
    text = text_or_empty()
    base = written(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key")), "sizes")
    groups = written(base.groupBy("key").agg(F.sum("size").alias("w")), "groups")
    placed = written(base.join(shard_groups(groups, shards), "key").drop("key"), "placed")
    return ranked(placed, ["shard"], ["doc_id", "size", "text_crc32"], "slot", "slots")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
