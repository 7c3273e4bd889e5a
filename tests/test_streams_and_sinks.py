from pyspark.sql import functions as F

from brindle.sources import sinks
from brindle.streaming import state


def drained(spark, df, tmp_path, mode):
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def stream(spark, rows, schema, tmp_path, batches=2):
    """Files read one a micro-batch, in the order of rows."""
    size = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_pacing_over_batches(spark, tmp_path):
    rows = [("a", i, t) for i, t in enumerate([0, 10, 20, 5000, 5001, 5002])]
    got = drained(spark, state.pacing(stream(spark, rows, "host string, id long, now long", tmp_path), 2000), tmp_path, "append")
    assert {r["id"]: r["slot"] for r in got} == {0: 0, 1: 2000, 2: 4000, 3: 6000, 4: 8000, 5: 10000}


def test_host_memory_and_breaker(spark, tmp_path):
    rows = [("h", 1, 1000, True, 500), ("h", 2, 2000, True, 500), ("h", 3, 3000, False, 200), ("h", 4, 10**7, True, 403)]
    got = drained(spark, state.host_memory(stream(spark, rows, "host string, id long, ts long, blocked boolean, status int", tmp_path)), tmp_path, "update")
    assert [(r["blocks"], r["browser_first_until"]) for r in got] == [(2, 902000), (1, 10**7 + 900000)]


def test_breaker(spark, tmp_path):
    rows = [("p", i, ok) for i, ok in enumerate([False, False, False, True])]
    got = drained(spark, state.breakers(stream(spark, rows, "provider string, id long, ok boolean", tmp_path, 4)), tmp_path, "update")
    assert [(r["failures"], r["open"]) for r in got] == [(1, False), (2, False), (3, True), (0, False)]


def test_sessions_and_tail(spark, tmp_path):
    rows = [(1, 10, "2024-01-01 00:00:00"), (2, 10, "2024-01-01 00:10:00"), (3, 10, "2024-01-01 02:00:00"), (4, 10, "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "id long, user_id long, t string").selectExpr("id", "user_id", "cast(t AS timestamp) AS ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = state.tailed(spark, str(tmp_path / "in"), "id long, user_id long, ts timestamp", 0)
    got = drained(spark, state.sessions(events), tmp_path, "append")
    assert sorted(r["n"] for r in got) == [1, 2]
    assert drained(spark, state.tailed(spark, str(tmp_path / "in"), "id long, user_id long, ts timestamp", 2), tmp_path / "b", "append").__len__() == 2


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": "1", "_x": "2", "b": ""}), (2, {"c": "3"}), (3, {"_only": "x"})], "id int, data map<string,string>")
    assert [r.asDict() for r in sinks.csv_rows(df).orderBy("a").collect()] == [{"a": "", "c": "3"}, {"a": "1", "c": ""}]
    sinks.json_lines(df, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":"1"}', '{"c":"3"}']


def test_upsert(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    batch = spark.createDataFrame([("a", "1", 0), ("b", "3", 1), ("b", "4", 2), ("c", "5", 3), (None, "6", 4)], "k string, v string, ord int")
    got = {r["k"]: (r["v"], r["_action"]) for r in sinks.upserted(stored, batch, ["k"], ["v"]).collect()}
    assert got == {"a": ("1", "none"), "b": ("3", "update"), "c": ("5", "insert")}
    assert sinks.upserted(stored, batch.where(F.lit(False)), ["k"], ["v"]).where("_action <> 'none'").count() == 0
