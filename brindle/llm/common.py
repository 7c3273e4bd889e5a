"""Shared helpers of the training-data operators: tables, shared scratch storage, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import workers_find_package

DEFAULT_SCRATCH = "/tmp/checkpoints"
#: A key with more than one in so many of the rows is looked up by broadcast.
HEAVY = 4_096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, by Spark's own reader."""
    return workers_find_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir; a local one only where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or DEFAULT_SCRATCH


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/brindle-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Says at a task's start that this worker now keeps entries for ``name``, which ``clear`` empties.

    A worker serves one operator after another; what an earlier one left is emptied, so only one holds a cache.
    """
    for other in [x for x in _held if x != name]:
        _held.pop(other)()
        pa.default_memory_pool().release_unused()
    _held[name] = clear


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def looked_up(rows: DataFrame, found: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the columns of ``found`` (one row per ``key``) or nulls; ``n`` there says how many rows have that key.

    Keys of more than one in ``HEAVY`` of all rows, so fewer than ``HEAVY`` of them, are broadcast and their rows
    stay where they are; the others are joined by a shuffle. Null keys find nothing and aren't shuffled either.
    Both should be written tables, because each is read twice.
    """
    total = found.agg(F.sum(n)).first()[0] or 0
    is_heavy = F.col(n) * HEAVY > total
    heavy = F.broadcast(found.where(is_heavy).drop(n).withColumn("_heavy", F.lit(True)))
    near = rows.join(heavy, key, "left").where(F.col("_heavy").isNotNull() | F.col(key).isNull()).drop("_heavy")
    far = rows.where(F.col(key).isNotNull()).join(heavy.select(key), key, "left_anti").join(found.where(~is_heavy).drop(n), key, "left")
    return near.unionByName(far)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, name: str) -> DataFrame:
    """Adds ``out``: a gapless rank from 0 within ``group``, without gathering a group in one task.

    A group is dealt into sub-buckets by a hash of ``order``; counts of the sub-buckets (one small
    row each) give the offsets, and ``row_number`` runs within a sub-bucket only. ``df`` should be
    a written table, because it is read twice. Ties in ``order`` take any of their places.
    """
    from pyspark.sql import Window

    n = partitions(df.sparkSession)
    dealt = df.withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = dealt.groupBy(*group, "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*group, "_sub").orderBy(*order)
    return (
        dealt.withColumn("_row", F.row_number().over(own))
        .join(offsets, [*group, "_sub"])
        .withColumn(out, (F.col("_row") - 1 + F.col("_before")).cast("long"))
        .drop("_sub", "_row", "_before")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges`` as (node, component), component the smallest node.

    Label propagation with pointer jumping: a node takes the smallest label among its neighbours,
    then the label of its label. Rounds grow with the logarithm of a component's diameter. Minima
    are aggregated map-side, so a hub of any degree costs one row per task; labels are cut
    from lineage after each round. Null ends and loops are ignored; no edges give no rows.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = both.where("node IS NOT NULL AND other IS NOT NULL AND node <> other")
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        stepped = written(
            least.join(jump, "component", "left").select("node", "old", F.least("component", "root").alias("component")), "labels"
        )
        labels = stepped.select("node", "component")
        if stepped.where("old <> component").isEmpty():
            return labels
