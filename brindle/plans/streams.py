"""Queries that run the events table as a stream into tables kept by it, and return what these then hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.plans.registry import query, table
from brindle.session import shared_dir
from brindle.streaming import versioned


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The events as a stream, and a new folder for what it keeps. The path is a pattern, since a stream's plain path must be a folder."""
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows, f"{shared_dir(spark)}/brindle-stream-{uuid.uuid4().hex}"


def _ended(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("summaries_streamed", """SELECT run, url_count, remaining, event_type, n FROM (SELECT user_id AS run, max(event_id) AS url_count, min(CASE WHEN event_type <> 'view' THEN 1000000 - event_id END) AS remaining FROM events GROUP BY user_id)
 JOIN (SELECT user_id AS run, event_type, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS n FROM events GROUP BY user_id, event_type) USING (run)""")
def summaries_streamed(spark, sf_dir) -> DataFrame:
    """Each event patches its run's summary; one row a run and kind of event."""
    rows, home = _stream(spark, sf_dir)
    patches = rows.select(F.col("user_id").alias("run"), F.col("event_id").alias("url_count"), F.when(F.col("event_type") != "view", 1000000 - F.col("event_id")).alias("remaining"), F.create_map("event_type", F.get_json_object("props", "$.k").cast("int")).alias("counts"))
    kept = versioned.VersionedTable(spark, f"{home}/summaries", StructType.fromDDL("run long, url_count long, remaining long, counts map<string,int>"))
    _ended(versioned.kept_table(patches, kept, f"{home}/offsets", lambda stored, batch: versioned.summaries_patched(stored, batch, "run", ["url_count"], ["remaining"], ["counts"])))
    return kept.read().select("run", "url_count", "remaining", F.explode("counts").alias("event_type", "n"))


@query("records_streamed", "SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value, 0 AS changed FROM events GROUP BY user_id, event_type")
def records_streamed(spark, sf_dir) -> DataFrame:
    """The first event of each user and kind is the record kept; the table comes as one batch, so none changes."""
    rows, home = _stream(spark, sf_dir)
    records = rows.select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("ord"))
    kept = versioned.VersionedTable(spark, f"{home}/records", StructType.fromDDL("user_id long, event_type string, event_id long, value double, changed int"))
    _ended(versioned.kept_table(records, kept, f"{home}/offsets", lambda stored, batch: versioned.records_kept(stored, batch, ["user_id", "event_type"], ["event_id", "value"])))
    return kept.read()


@query("slots_streamed", """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CAST(event_id * 100 AS BIGINT) AS now, event_type = 'error' AS fended FROM events),
 p AS (SELECT user_id, event_id, n, fended, now AS slot, now + CASE WHEN fended THEN 2000 ELSE 250 END AS free FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, e.fended, greatest(e.now, p.free), CASE WHEN e.fended THEN greatest(p.free, e.now + 2000) ELSE greatest(e.now, p.free) + 250 END FROM p JOIN e ON e.user_id = p.user_id AND e.n = p.n + 1)
 SELECT CAST(user_id AS VARCHAR) AS host, event_id AS id, slot FROM p WHERE NOT fended""")
def slots_streamed(spark, sf_dir) -> DataFrame:
    """Events as requests to their user's host, errors as outcomes that ask for a pause: the slot of each request."""
    rows, home = _stream(spark, sf_dir)
    requests = rows.select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("id"), (F.col("event_id") * 100).alias("now"), (F.col("event_type") == "error").alias("fended"))
    kept = versioned.VersionedTable(spark, f"{home}/hosts", StructType.fromDDL("host string, free_at long"))
    _ended(versioned.paced_stream(requests, kept, f"{home}/slots", f"{home}/offsets"))
    return spark.read.schema("host string, id long, _kind int, slot long, batch long").parquet(f"{home}/slots").where("_kind = 0").select("host", "id", "slot")
