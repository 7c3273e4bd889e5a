"""Queries over runs, records and logs: orders, customers, line items and events stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import folds, prefix
from brindle.plans.registry import query, table

VERDICT = {"purchase": "success", "signup": "success", "click": "partial", "view": "partial", "error": "error"}
_VERDICT_SQL = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in VERDICT.items()) + " ELSE '' END"


def _verdict():
    out = F.lit("")
    for k, v in VERDICT.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return out


@query("runs_records_join", "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def runs_records_join(spark, sf_dir) -> DataFrame:
    """Filtered join and count; Catalyst pushes both filter and columns to the scans and picks the join by size."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(customers, "o_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("runs_filtered_page", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) LIKE '%high%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def runs_filtered_page(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & F.contains(F.lower("o_orderpriority"), F.lit("high")))
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(20).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("keyset_tail", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def keyset_tail(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id > 500").orderBy("event_id").limit(100).select("event_id", "user_id", "event_type")


@query("active_status_in", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type IN ('click', 'view', 'signup')")
def active_status_in(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "signup")).select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("latest_per_key", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir) -> DataFrame:
    """The latest row per key by an aggregate of structs: map-side combined, where a window would sort all rows."""
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("r")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last).select("user_id", "r.ts", "r.event_id", "r.event_type")


@query("best_per_key", "SELECT p_brand, arg_min(p_partkey, (-p_retailprice, p_partkey)) AS p_partkey, max(p_retailprice) AS price FROM part GROUP BY p_brand")
def best_per_key(spark, sf_dir) -> DataFrame:
    best = F.min(F.struct((-F.col("p_retailprice")).alias("low"), "p_partkey")).alias("r")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(best).select("p_brand", "r.p_partkey", (-F.col("r.low")).alias("price"))


@query("capped_per_group", "SELECT p_brand, p_partkey, rank, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3 ORDER BY place LIMIT 30")
def capped_per_group(spark, sf_dir) -> DataFrame:
    """At most three a brand, then the thirty best of all; the global rank runs over those thirty only."""
    own = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    few = table(spark, sf_dir, "part").withColumn("rank", F.row_number().over(own)).where("rank <= 3").orderBy(F.desc("p_retailprice"), "p_partkey").limit(30)
    return few.select("p_brand", "p_partkey", "rank", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("place"))


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("run_verdict", f"""SELECT user_id, CASE WHEN n = 0 THEN 'empty' WHEN good THEN CASE WHEN only_success THEN 'success' ELSE 'partial' END WHEN error THEN 'error' ELSE last END AS verdict,
 failures, n AS total, round(failures / n, 4) AS failure_rate, CASE WHEN failures / n >= 0.25 THEN 'failed' WHEN failures / n >= 0.05 THEN 'degraded' ELSE 'healthy' END AS health
 FROM (SELECT user_id, count(*) AS n, bool_or(v IN ('success', 'partial')) AS good, bool_and(v = 'success') AS only_success, bool_or(v = 'error') AS error, arg_max(v, event_id) AS last,
 count(*) FILTER (v NOT IN ('success', 'partial')) AS failures FROM (SELECT *, {_VERDICT_SQL} AS v FROM events) WHERE v <> '' GROUP BY user_id)""")
def run_verdict(spark, sf_dir) -> DataFrame:
    """Bag of verdicts and health of each run in one aggregate."""
    return folds.run_verdicts(table(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_id").alias("idx"), _verdict().alias("verdict")), "user_id")


@query("run_quality_rollup", """SELECT user_id, count(*) AS n, round(avg(q), 4) AS quality, count(*) FILTER (q >= 0.8) AS high, count(*) FILTER (q >= 0.5 AND q < 0.8) AS medium, count(*) FILTER (q < 0.5) AS low
 FROM (SELECT user_id, least(greatest(value / 50, 0), 1) AS q FROM events) GROUP BY user_id""")
def run_quality_rollup(spark, sf_dir) -> DataFrame:
    q = F.least(F.greatest(F.col("value") / 50, F.lit(0.0)), F.lit(1.0))
    rows = table(spark, sf_dir, "events").select("user_id", q.alias("q"))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.avg("q"), 4).alias("quality"), F.count_if(F.col("q") >= 0.8).alias("high"),
        F.count_if((F.col("q") >= 0.5) & (F.col("q") < 0.8)).alias("medium"), F.count_if(F.col("q") < 0.5).alias("low"),
    )


@query("acquisition_rollup", """SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors,
 round(sum(value), 3) AS value_total, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS k_max FROM events GROUP BY user_id""")
def acquisition_rollup(spark, sf_dir) -> DataFrame:
    count = lambda kind, name: F.count_if(F.col("event_type") == kind).alias(name)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("total"), count("click", "clicks"), count("view", "views"), count("error", "errors"),
        F.round(F.sum("value"), 3).alias("value_total"), F.max(F.get_json_object("props", "$.k").cast("int")).alias("k_max"),
    )


@query("ops_duration_metrics", """SELECT count(*) AS n, round(avg(days), 2) AS avg_days, count(*) FILTER (days >= 60) AS slow, count(*) FILTER (lines IS NULL) AS without_lines FROM (
 SELECT o_orderkey, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), CAST(last AS DATE))) AS days, lines FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000)
 LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""")
def ops_duration_metrics(spark, sf_dir) -> DataFrame:
    """Durations of the latest 1000 orders (the feature's limit); the thousand keys restrict the line items before they are summed."""
    latest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1000)
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(F.broadcast(latest.select("o_orderkey")), "o_orderkey", "left_semi")
    last = lines.groupBy("o_orderkey").agg(F.max("l_shipdate").alias("last"), F.count("*").alias("lines"))
    days = F.greatest(F.lit(0), F.date_diff("last", "o_orderdate"))
    rows = latest.join(last, "o_orderkey", "left").select(F.when(F.col("last").isNotNull(), days).otherwise(0).alias("days"), "lines")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("days"), 2).alias("avg_days"), F.count_if(F.col("days") >= 60).alias("slow"), F.count_if(F.col("lines").isNull()).alias("without_lines"))


@query("export_fill_rate", """SELECT field, count(*) AS n, count(v) AS filled, round(count(v) / count(*), 4) AS fill_rate, round(count(v) / count(*), 4) >= 0.8 AS passes FROM (
 SELECT unnest(['quality', 'toxic', 'lang', 'text']) AS field, unnest([CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR), nullif(lang, ''), nullif(text, '')]) AS v FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY field""")
def export_fill_rate(spark, sf_dir) -> DataFrame:
    """Share of filled values per field, in one row of counters; only ids and flags are joined, never values."""
    filled = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c)
    rows = table(spark, sf_dir, "documents").select("doc_id", filled("lang"), filled("text")).join(table(spark, sf_dir, "labels").select("doc_id", filled("quality"), filled("toxic")), "doc_id", "left")
    fields = ["quality", "toxic", "lang", "text"]
    sums = rows.agg(F.count("*").alias("n"), *(F.count_if(f).alias(f) for f in fields))
    out = sums.unpivot("n", fields, "field", "filled").withColumn("fill_rate", F.round(F.col("filled") / F.col("n"), 4))
    return out.select("field", "n", "filled", "fill_rate", (F.col("fill_rate") >= 0.8).alias("passes"))


@query("record_field_keys", "SELECT DISTINCT unnest(json_keys(props)) AS field FROM events")
def record_field_keys(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("field")).distinct()


@query("summary_merge", """SELECT user_id, greatest(a_count, b_count) AS url_count, greatest(a_done, b_done) AS progress, least(a_left, b_left) AS remaining FROM (SELECT user_id,
 count(*) FILTER (event_id % 2 = 0) AS a_count, count(*) FILTER (event_id % 2 = 1) AS b_count, coalesce(max(event_id) FILTER (event_id % 2 = 0), 0) AS a_done, coalesce(max(event_id) FILTER (event_id % 2 = 1), 0) AS b_done,
 count(*) FILTER (event_id % 2 = 0 AND event_type = 'error') AS a_left, count(*) FILTER (event_id % 2 = 1 AND event_type = 'error') AS b_left FROM events GROUP BY user_id)""")
def summary_merge(spark, sf_dir) -> DataFrame:
    """Two partial summaries of each run merged: the larger counters, the smaller rest."""
    parts = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 2).alias("part")).agg(
        F.count("*").alias("url_count"), F.max("event_id").alias("progress"), F.count_if(F.col("event_type") == "error").alias("remaining"))
    return folds.merge_summaries(parts, "user_id", 2)


@query("log_sampling", "SELECT event_id, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n % 4 = 1 AND n <= 1000")
def log_sampling(spark, sf_dir) -> DataFrame:
    """Every fourth log line of a run, up to its thousandth (the feature's sampling)."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return prefix.running(rows, "user_id", ["event_id"], {"n": (prefix.SUM, F.lit(1))}).where("n % 4 = 1 AND n <= 1000")


@query("status_transitions", """SELECT before, event_type AS after, count(*) AS n, NOT (before = 'purchase' AND event_type = 'signup') AS legal FROM (
 SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY before, event_type""")
def status_transitions(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("after"))
    steps = prefix.running(rows, "user_id", ["event_id"], {"before": (prefix.PREVIOUS, F.col("after"))}).where("before IS NOT NULL")
    return steps.groupBy("before", "after").agg(F.count("*").alias("n")).withColumn("legal", ~((F.col("before") == "purchase") & (F.col("after") == "signup")))


@query("stale_gaps", """SELECT event_id, user_id, gap FROM (SELECT event_id, user_id, date_diff('second', date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), date_trunc('second', ts)) AS gap FROM events) WHERE gap > 86400""")
def stale_gaps(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    place = F.unix_micros(F.col("ts").cast("timestamp"))
    told = prefix.running(rows, "user_id", ["ts", "event_id"], {"last": (prefix.PREVIOUS, F.col("ts"))}, place)
    gap = F.timestamp_diff("SECOND", F.date_trunc("second", "last"), F.date_trunc("second", "ts"))
    return told.select("event_id", "user_id", gap.alias("gap")).where("gap > 86400")


@query("breaker_state", """SELECT user_id, max(streak) AS longest, count(*) FILTER (streak >= 2) AS opened FROM (SELECT user_id, grp, count(*) AS streak FROM (SELECT user_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM events)
 WHERE event_type = 'error' GROUP BY user_id, grp) GROUP BY user_id""")
def breaker_state(spark, sf_dir) -> DataFrame:
    """Streaks of failures by gaps and islands: a run of errors shares the count of the successes before it."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    islands = prefix.running(rows, "user_id", ["event_id"], {"grp": (prefix.SUM, F.when(F.col("event_type") != "error", 1).otherwise(0))})
    streaks = islands.where("event_type = 'error'").groupBy("user_id", "grp").agg(F.count("*").alias("streak"))
    return streaks.groupBy("user_id").agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") >= 2).alias("opened"))


@query("host_pacing", """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CAST(event_id * 100 AS BIGINT) AS now FROM events),
 p AS (SELECT user_id, event_id, n, now, now AS slot FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, e.now, greatest(e.now, p.slot + 2000) FROM p JOIN e ON e.user_id = p.user_id AND e.n = p.n + 1)
 SELECT user_id, event_id, slot, slot - now AS wait FROM p""")
def host_pacing(spark, sf_dir) -> DataFrame:
    """Slots of a host at least 2000 ms apart, by two running folds: no Python, no recursion, no host's rows in one task."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 100).alias("now"))
    return folds.paced(events, "user_id", "event_id", "now", 2000)


@query("cost_rollup", """SELECT role, count(*) AS turns, sum(tokens) AS tokens, CAST(round(sum(tokens) * CASE WHEN role = 'user' THEN 3 ELSE 15 END / 1000000.0, 4) AS DOUBLE) AS cost_usd FROM (SELECT role, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM conversations) GROUP BY role""")
def cost_rollup(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("role", F.ceil(F.char_length("text") / 4).alias("tokens"))
    rate = F.when(F.col("role") == "user", 3).otherwise(15)
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens")).withColumn("cost_usd", F.round(F.col("tokens") * rate / 1000000.0, 4))


@query("quota_reserved", "SELECT conv_id, count(*) AS calls, count(*) FILTER (turn < 4) AS granted FROM conversations WHERE role = 'user' OR role = 'assistant' GROUP BY conv_id")
def quota_reserved(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("calls"), F.count_if(F.col("turn") < 4).alias("granted"))


@query("candidate_ready_antijoin", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def candidate_ready_antijoin(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


@query("session_windows", """SELECT user_id, min(ts) AS opened, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_windows(spark, sf_dir) -> DataFrame:
    """Sessions that end after thirty quiet minutes, by Spark's session window."""
    out = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("opened"), "n")


@query("status_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def status_rollup(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("asof_previous_purchase", """SELECT event_id, user_id, last_purchase FROM (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events) WHERE event_type = 'error'""")
def asof_previous_purchase(spark, sf_dir) -> DataFrame:
    """An as-of join of errors to purchases without a join of both: one running fold over their union."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").where(F.col("event_type").isin("error", "purchase"))
    last = {"last_purchase": (prefix.MAX_BEFORE, F.when(F.col("event_type") == "purchase", F.col("event_id")))}
    return prefix.running(rows, "user_id", ["event_id"], last).where("event_type = 'error'").drop("event_type")


@query("steps_processed", """SELECT event_id, user_id, gathered, CASE WHEN before >= 300 THEN 'enough' WHEN stop = 1 THEN 'halted' ELSE 'done' END AS outcome FROM (SELECT *, gathered - event_id % 7 AS before FROM (
 SELECT event_id, user_id, CAST(sum(event_id % 7) OVER w AS BIGINT) AS gathered, max(CASE WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN 1 ELSE 0 END) OVER w AS stop FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)))""")
def steps_processed(spark, sf_dir) -> DataFrame:
    """Which steps of a run are done before it is halted or has enough records."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    halted = (F.col("event_type") == "purchase") & (F.col("event_id") % 11 == 0)
    return prefix.processed(rows, "user_id", "event_id", F.col("event_id") % 7, halted, 300).select("event_id", "user_id", "gathered", "outcome")
