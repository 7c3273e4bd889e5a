import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.types import StructType

from brindle.streaming import versioned
from tests.test_streams_and_sinks import stream

SUMMARY = "run long, done long, remaining long, verdicts map<string,int>"


def table(spark, tmp_path, schema):
    return versioned.VersionedTable(spark, str(tmp_path / "kept"), StructType.fromDDL(schema))


def patched(stored, patches):
    return versioned.summaries_patched(stored, patches, "run", ["done"], ["remaining"], ["verdicts"])


def test_summaries_over_batches_and_a_repeated_batch(spark, tmp_path):
    rows = [(1, 2, 8, {"ok": 1}), (2, 1, None, None), (1, 5, 5, {"ok": 3, "bad": 1}), (None, 9, 9, None), (1, 4, 6, {"ok": 2, "bad": None}), (2, None, 3, {})]
    kept = table(spark, tmp_path, SUMMARY)
    q = versioned.kept_table(stream(spark, rows, SUMMARY, tmp_path, 3), kept, str(tmp_path / "ck"), patched)
    assert q.awaitTermination(120) and q.exception() is None
    want = {1: (5, 5, {"ok": 3, "bad": 1}), 2: (1, 3, None)}
    assert {r["run"]: (r["done"], r["remaining"], r["verdicts"]) for r in kept.read().collect()} == want
    assert len(kept.versions()) == versioned.KEPT
    assert not kept.merge(2, lambda stored: stored.limit(0))  # merged before: nothing happens
    assert kept.read().count() == 2


def test_a_version_without_its_mark_does_not_count(spark, tmp_path):
    kept = table(spark, tmp_path, "k long")
    assert kept.versions() == [] and kept.read().count() == 0
    assert kept.merge(0, lambda stored: spark.range(3).toDF("k"))
    spark.range(99).toDF("k").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{kept.path}/version=1")
    assert kept.read().count() == 3
    assert kept.merge(1, lambda stored: stored.union(spark.range(3, 5).toDF("k")))
    assert sorted(r["k"] for r in kept.read().collect()) == [0, 1, 2, 3, 4]


def test_records_are_kept_and_changed(spark, tmp_path):
    schema = "k string, v string, changed int"
    kept = table(spark, tmp_path, schema)
    rows = [("a", "1", 0), ("a", "9", 1), (None, "x", 2), ("a", "1", 0), ("b", "2", 1), (None, "y", 2), ("a", "3", 0), ("a", "4", 1), ("b", None, 2)]
    q = versioned.kept_table(stream(spark, rows, "k string, v string, ord int", tmp_path, 3), kept, str(tmp_path / "ck"), lambda s, b: versioned.records_kept(s, b, ["k"], ["v"]))
    assert q.awaitTermination(120) and q.exception() is None
    assert {r["k"]: (r["v"], r["changed"]) for r in kept.read().collect()} == {"a": ("3", 1), "b": (None, 1)}


def served_one_by_one(rows, apart, protected, free):
    """The rule as it reads, row by row."""
    slots = {}
    for host, now, i, fended in sorted((h, n, i, f) for h, i, n, f in rows if h is not None):
        if fended:
            free[host] = max(free.get(host, now), now + protected)
        else:
            slots[i] = max(now, free.get(host, now))
            free[host] = slots[i] + apart
    return slots


def test_slots_over_batches_equal_one_by_one(spark):
    draw, free, stored, start = random.Random(3), {}, spark.createDataFrame([], "host string, free_at long"), 0
    for batch in range(3):
        rows = [(draw.choice(["hot", "hot", "hot", "a", "b", None]), batch * 200 + i, start + draw.randint(0, 9000), draw.random() < 0.2) for i in range(200)]
        start += 9000 + 10_000 * batch
        want = served_one_by_one(rows, 250, 2000, free)
        served = versioned.slots_served(stored, spark.createDataFrame(rows, "host string, id long, now long, fended boolean"))
        got = served.collect()
        assert {r["id"]: r["slot"] for r in got if r["_kind"] == 0} == want
        kept = versioned.hosts_kept(stored, served, memory=5000).collect()
        last = max(n for h, _, n, _ in rows if h is not None)
        free = {h: t for h, t in free.items() if t + 5000 >= last}
        assert {r["host"]: r["free_at"] for r in kept} == free
        stored = spark.createDataFrame([tuple(r) for r in kept], "host string, free_at long")
    nothing = versioned.slots_served(stored, spark.createDataFrame([], "host string, id long, now long, fended boolean"))
    assert nothing.count() == 0 and versioned.hosts_kept(stored, nothing).count() == stored.count()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.none() | st.integers(0, 9), st.none() | st.integers(0, 9)), min_size=1, max_size=8), st.randoms())
def test_patches_in_any_order_and_twice(spark, rows, draw):
    shown = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    rows = [(*r, {"ok": r[1]}) for r in rows]
    empty = spark.createDataFrame([], SUMMARY)
    once = patched(empty, spark.createDataFrame(rows, SUMMARY))
    mixed = rows + rows[:2]
    draw.shuffle(mixed)
    halves = patched(patched(empty, spark.createDataFrame(mixed[:3], SUMMARY)), spark.createDataFrame(mixed[3:], SUMMARY))
    assert shown(once) == shown(halves)
