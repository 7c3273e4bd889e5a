"""Folds of the reference's run state as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import prefix

GOOD = ("success", "partial")


def run_verdicts(rows: DataFrame, key: str) -> DataFrame:
    """(key, verdict, failures, total, failure_rate, health) from (key, idx, verdict).

    Blank verdicts don't count. Any success or partial makes the run success if there is nothing else than success, else
    partial; else an error decides, then blocked, then a listing failure; else the last one by idx. A key
    with blanks only gives no row.
    """
    v = F.col("verdict")
    has = lambda x: F.bool_or(v == x).alias(x)
    sums = rows.where("verdict <> ''").groupBy(key).agg(
        F.count("*").alias("total"), F.bool_or(v.isin(*GOOD)).alias("good"), F.bool_and(v == "success").alias("only"), has("error"), has("blocked"), has("listing_detection_failed"),
        F.max_by("verdict", "idx").alias("last"), F.count_if(~v.isin(*GOOD)).alias("failures"),
    )
    bad = F.when(F.col("error"), "error").when(F.col("blocked"), "blocked").when(F.col("listing_detection_failed"), "listing_detection_failed").otherwise(F.col("last"))
    rate = F.col("failures") / F.col("total")
    return sums.select(
        key, F.when(F.col("good"), F.when(F.col("only"), "success").otherwise("partial")).otherwise(bad).alias("verdict"), "failures", "total",
        F.round(rate, 4).alias("failure_rate"), F.when(rate >= 0.25, "failed").when(rate >= 0.05, "degraded").otherwise("healthy").alias("health"),
    )


def merge_summaries(parts: DataFrame, key: str, expected: int) -> DataFrame:
    """Partial summaries (key, url_count, progress, remaining) merged in any order: greatest counters, least rest.

    Of ``expected`` parts a missing one counts as zeros, as an empty summary does.
    """
    rest = F.when(F.count("*") < expected, F.lit(0)).otherwise(F.min("remaining"))
    return parts.groupBy(key).agg(F.max("url_count").alias("url_count"), F.max("progress").alias("progress"), rest.alias("remaining"))


def paced(rows: DataFrame, key: str, order: str, now: str, apart: int) -> DataFrame:
    """(key, order, slot, wait): each request's slot, at least ``apart`` after the one before of its key and not before ``now``.

    slot_n = max(now_n, slot_(n-1) + apart) unrolls to apart * n + max over k <= n of (now_k - apart * k), a running maximum. It is
    taken within blocks by the place there, and carried on by block: rows are blocked and shuffled once.
    """
    own = Window.partitionBy(key, "_block").orderBy(order)
    dealt = prefix.in_blocks(rows, F.col(order)).withColumn("_n", F.row_number().over(own)).withColumn("_free", F.col(now) - apart * F.col("_n"))
    blocks = dealt.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_at")).agg(F.count("*").alias("_rows"), F.max("_free").alias("_most"))
    past = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(past), F.lit(0)))
    blocks = blocks.select("_key", "_at", "_before", F.max(F.col("_most") - apart * F.col("_before")).over(past).alias("_carried"))
    met = dealt.join(blocks, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")))
    most = F.greatest("_carried", F.max("_free").over(own) - apart * F.col("_before"))
    slot = most + apart * (F.col("_before") + F.col("_n"))
    return met.select(key, order, slot.alias("slot"), (slot - F.col(now)).alias("wait"))
