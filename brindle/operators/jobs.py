"""Jobs, profiles and results: overlays, latest rows, ordered merges and summaries, without windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, a count for each part): each part is counted by its key before the counts are brought together."""
    counts = [df.groupBy(key).agg(F.count("*").alias("_n")).select(key, F.lit(name).alias("_kind"), "_n") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, counts).groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("_kind") == name, F.col("_n"))), F.lit(0)).alias(name) for name in parts))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``: a maximum of structs, kept small map-side."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def overlaid(explicit: DataFrame, saved: DataFrame, on: list[str], fields: list[str], default: dict[str, Column]) -> DataFrame:
    """Settings by field: the explicit value, else the saved one of the same keys, else the default."""
    kept = saved.select(*on, *(F.col(f).alias(f"_saved_{f}") for f in fields))
    out = explicit.join(kept, on, "left")
    return out.withColumns({f: F.coalesce(f, f"_saved_{f}", default[f]) for f in fields}).drop(*(f"_saved_{f}" for f in fields))


def merged_in_order(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row a key: of each field the first value that isn't empty, sources in the order given. Rows without a key stay, each distinct one once."""
    first = lambda f: F.min_by(f, F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "", F.struct(*order))).alias(f)
    alone = F.when(F.col(key).isNull(), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).alias("_alone")
    return rows.groupBy(key, alone).agg(*map(first, fields)).drop("_alone")


def outcome(persisted: Column, blocked: Column, verdict: Column) -> Column:
    """Whether what fetched an address is worth keeping: success, failure (a listing not found), or neither."""
    good = (persisted > 0) & ~blocked & ~verdict.isin("blocked", "empty", "listing_detection_failed")
    return F.when(good, "success").when(verdict == "listing_detection_failed", "failure").otherwise("neither")
