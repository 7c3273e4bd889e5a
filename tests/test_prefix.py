"""Running folds in blocks against a plain loop, with a key that has most rows, ties, nulls and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import folds, prefix

ROWS = "k string, o long, v int, _block int, place int"


def looped(rows, kind):
    """What each row gets, by (key, order), one key after another."""
    out, of = {}, {}
    for k, o, v, *_ in rows:
        of.setdefault(k, []).append((o, v))
    for k, own in of.items():
        total, most, last = 0, None, None
        for o, v in sorted(own, key=lambda x: (x[0] is not None, x[0] or 0)):
            before = most
            total += v or 0
            most = v if most is None else most if v is None else max(most, v)
            out[k, o] = {"sum": total, "max": most, "max_before": before, "previous": last}[kind]
            last = v
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_folds_equal_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), o, rng.choice([None, *range(-5, 30)]), 0, 0) for o in rng.sample(range(-500, 10**9) if seed > 1 else range(2_000), 400)] + [("a", None, 7, 0, 0)]
    frame = spark.createDataFrame(rows, ROWS).select("k", "o", "v").repartition(5)
    kinds = (prefix.SUM, prefix.MAX, prefix.MAX_BEFORE, prefix.PREVIOUS)
    got = prefix.running(frame, "k", ["o"], {kind: (kind, F.col("v")) for kind in kinds}).collect()
    assert len(got) == len(rows)
    for kind in kinds:
        assert {(r["k"], r["o"]): r[kind] for r in got} == looped(rows, kind)


def test_order_beyond_the_place(spark):
    rows = [("x", i // 3, i % 3, 0, 0) for i in range(60)]
    got = prefix.running(spark.createDataFrame(rows, ROWS).drop("_block"), "k", ["o", "v"], {"n": (prefix.SUM, F.lit(1))}).collect()
    assert sorted((r["o"], r["v"], r["n"]) for r in got) == [(i // 3, i % 3, i + 1) for i in range(60)]


def test_no_rows_and_one_row(spark):
    none = spark.createDataFrame([], ROWS).select("k", "o", "v")
    assert prefix.running(none, "k", ["o"], {"n": (prefix.SUM, F.lit(1))}).count() == 0
    one = prefix.running(spark.createDataFrame([("k", 5, 1, 0, 0)], ROWS).select("k", "o", "v"), "k", ["o"], {"p": (prefix.PREVIOUS, F.col("v")), "m": (prefix.MAX_BEFORE, F.col("v"))}).collect()
    assert [(r["p"], r["m"]) for r in one] == [(None, None)]


def test_a_hot_key_is_spread(spark):
    rows = spark.range(4_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), F.lit(1).alias("v"))
    cuts = rows.approxQuantile("o", [0.25, 0.5, 0.75], 0.0625)
    sizes = [r["count"] for r in rows.groupBy(prefix.block_of(F.col("o").cast("double"), cuts).alias("b")).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.6 * min(sizes)


def test_block_numbers(spark):
    cuts = [1.0, 2.0, 2.5, 7.0, 9.0]
    rows = spark.createDataFrame([(x,) for x in (-1.0, 1.0, 2.2, 2.5, 8.0, 100.0, None)], "x double").select("x", prefix.block_of(F.col("x"), cuts).alias("b"), prefix.block_of(F.col("x"), []).alias("z"))
    assert [(r["x"], r["b"], r["z"]) for r in rows.collect()] == [(x, sum(c <= x for c in cuts) if x is not None else 0, 0) for x in (-1.0, 1.0, 2.2, 2.5, 8.0, 100.0, None)]


def test_slots_equal_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, rng.randrange(0, 50_000), 0, 0) for i in range(200)]
    got = {r["o"]: (r["slot"], r["wait"]) for r in folds.paced(spark.createDataFrame(rows, ROWS).select("k", "o", "v"), "k", "o", "v", 700).collect()}
    free = {}
    for k, o, now, *_ in rows:
        slot = max(now, free.get(k, now))
        free[k] = slot + 700
        assert got[o] == (slot, slot - now)


def test_runs_stop(spark):
    rows = [("r", i, n, h, 0) for i, (n, h) in enumerate([(3, 0), (None, 0), (4, 0), (5, 0), (1, 1), (1, 0)])] + [("s", 10, 1, 0, 0), ("s", 11, 1, 1, 0), ("s", 12, 1, 0, 0)]
    frame = spark.createDataFrame(rows, ROWS).select("k", "o", "v", F.col("_block").alias("h"))
    got = {r["o"]: (r["gathered"], r["outcome"]) for r in prefix.processed(frame, "k", "o", F.col("v"), F.col("h") == 1, 7).collect()}
    assert got == {0: (3, "done"), 1: (3, "done"), 2: (7, "done"), 3: (12, "enough"), 4: (13, "enough"), 5: (14, "enough"), 10: (1, "done"), 11: (2, "halted"), 12: (3, "halted")}
