"""Running folds by key in two levels: within blocks, and what blocks carry on; so no key's rows meet in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a fold gives a row: the sum up to it, the largest value up to or before it, or the value of the row before it.
SUM, MAX, MAX_BEFORE, PREVIOUS = "sum", "max", "max_before", "previous"


def block_of(place: Column, cuts: Sequence[float]) -> Column:
    """How many of the sorted ``cuts`` are at or below ``place``, by halving; 0 for null."""
    size = 1
    while size <= len(cuts):
        size *= 2
    array = F.array(*(F.lit(float(c)) for c in cuts), *(F.lit(float("inf")) for _ in range(size - len(cuts))))
    steps = [size >> i for i in range(1, size.bit_length())]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, s: F.when(F.get(array, low + s - 1) <= place, low + s).otherwise(low))


def in_blocks(rows: DataFrame, place: Column) -> DataFrame:
    """``rows`` with ``_block``, cut at quantiles of ``place`` over all of them into as many blocks as there are shuffle partitions."""
    n, place = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), place.cast("double")
    cuts = rows.select(place.alias("place")).approxQuantile("place", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    return rows.withColumn("_block", block_of(place, sorted(set(cuts))))


def running(rows: DataFrame, key: str, order: Sequence[str], folds: Mapping[str, tuple[str, Column]], place: Column | None = None) -> DataFrame:
    """``rows`` with a column for each of ``folds`` (name: (kind, values)), folded along ``order`` within ``key``.

    Rows are cut into as many blocks as the session has shuffle partitions, at quantiles of ``place`` (the first column of
    ``order`` as a number) over all keys: a block holds an equal share of all rows, so a key that has most of them is spread over
    all blocks. Rows of one place stay in a block; the place should tell rows apart, as an id or a time does, and grow with
    the order. Each block of a key is folded on its own and starts from what the key's blocks before it carry: one
    row a key and block. Null values add nothing to sums; a sum over none is 0. Null keys are a key of their own, null places come first.
    """
    dealt = in_blocks(rows.withColumns({f"_in_{name}": value for name, (_, value) in folds.items()}), F.col(order[0]) if place is None else place)
    total = {SUM: F.sum, MAX: F.max, MAX_BEFORE: F.max, PREVIOUS: lambda v: F.max_by(v, F.struct(*order))}
    blocks = dealt.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_at")).agg(*(total[kind](f"_in_{name}").alias(f"_total_{name}") for name, (kind, _) in folds.items()))
    line = Window.partitionBy("_key").orderBy("_at")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    carry = {SUM: lambda t: F.sum(t).over(past), MAX: lambda t: F.max(t).over(past), MAX_BEFORE: lambda t: F.max(t).over(past), PREVIOUS: lambda t: F.lag(t).over(line)}
    blocks = blocks.select("_key", "_at", *(carry[kind](f"_total_{name}").alias(f"_carry_{name}") for name, (kind, _) in folds.items()))
    own = Window.partitionBy(key, "_block").orderBy(*order)
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)

    def folded(name: str, kind: str) -> Column:
        value, carried = F.col(f"_in_{name}"), F.col(f"_carry_{name}")
        if kind == SUM:
            return F.coalesce(F.sum(value).over(upto), F.lit(0)) + F.coalesce(carried, F.lit(0))
        if kind == PREVIOUS:
            return F.when(F.row_number().over(own) == 1, carried).otherwise(F.lag(value).over(own))
        return F.greatest(carried, F.max(value).over(upto if kind == MAX else before))

    met = dealt.join(blocks, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")))
    return met.select(*rows.columns, *(folded(name, kind).alias(name) for name, (kind, _) in folds.items()))


def processed(rows: DataFrame, key: str, order: str, records: Column, halted: Column, most: int) -> DataFrame:
    """``rows`` with ``gathered``, the records of a run up to this step, and ``outcome``: done, halted or enough.

    A run's steps are done in order until one finds the run halted, or ``most`` records gathered by the steps before it;
    then none is done any more. A step's own records may go beyond ``most``.
    """
    folded = running(rows.withColumns({"_records": records.cast("long"), "_halted": halted.cast("int")}), key, [order], {"gathered": (SUM, F.col("_records")), "_stop": (MAX, F.col("_halted"))})
    before = F.col("gathered") - F.coalesce("_records", F.lit(0))
    outcome = F.when(F.col("_stop") == 1, F.when(before >= most, "enough").otherwise("halted")).when(before >= most, "enough").otherwise("done")
    return folded.select(*rows.columns, "gathered", outcome.alias("outcome"))
