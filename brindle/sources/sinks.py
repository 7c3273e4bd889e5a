"""Exports of records: JSON lines, CSV over the union of keys, fixed schemas, and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.records import public_map


def json_lines(records: DataFrame, path: str) -> None:
    """One cleaned record a line, in as many files as there are partitions."""
    records.select(public_map(F.col("data")).alias("data")).where(F.size("data") > 0).select(F.to_json("data").alias("value")).write.text(path)


def csv_columns(records: DataFrame) -> list[str]:
    """The sorted names of all populated fields: a distinct over keys, whose number is bounded by the contract, not by rows."""
    return [r["k"] for r in records.select(F.explode(F.map_keys(public_map(F.col("data")))).alias("k")).distinct().orderBy("k").collect()]


def csv_rows(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One column a field, '' where a record lacks it; records without any of them are left out."""
    data = public_map(F.col("data"))
    names = csv_columns(records) if columns is None else columns
    kept = records.withColumn("_d", data).where(F.size("_d") > 0)
    return kept.select(*(F.coalesce(F.try_element_at("_d", F.lit(n)), F.lit("")).alias(n) for n in names))


def first_of_key(batch: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """(key, _row): of rows with one key the first by ``ord``; rows with a null in the key are left out. Combined map-side."""
    return batch.where(" AND ".join(f"{k} IS NOT NULL" for k in key)).groupBy(*key).agg(F.min_by(F.struct(*content), "ord").alias("_row"))


def upserted(stored: DataFrame, batch: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """``stored`` with a batch merged in, and ``_action`` none, insert or update for each row.

    Of rows of the batch with one key the first by ``ord`` counts; an equal row changes nothing; a batch row with a null
    key is left out. One shuffle by key on either side; the batch is reduced before it.
    """
    first = first_of_key(batch, key, content).withColumnRenamed("_row", "_new")
    old = stored.select(*key, F.struct(*content).alias("_old"))
    joined = old.join(first, key, "full")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull() | F.col("_old").eqNullSafe(F.col("_new")), "none").otherwise("update")
    return joined.select(*key, F.coalesce("_new", "_old").alias("_row"), action.alias("_action")).select(*key, "_row.*", "_action")
