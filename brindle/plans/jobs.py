"""Queries over jobs, profiles and results; the tables stand in for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import prices, text, urls
from brindle.operators import jobs, records
from brindle.plans.registry import query, table
from brindle.plans.values import given, values_sql

_COUNTED = ["customer", "events", "orders", "part", "supplier"]


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def table_counts(spark, sf_dir) -> DataFrame:
    return reduce(DataFrame.unionByName, (table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _COUNTED))


@query("job_summaries", """SELECT n_nationkey AS job, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS sources, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS candidates, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AS matches FROM nation WHERE sources + candidates > 0""")
def job_summaries(spark, sf_dir) -> DataFrame:
    sources = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("job"), "c_acctbal")
    return jobs.counted({"sources": sources, "candidates": table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("job")), "matches": sources.where("c_acctbal > 5000")}, "job")


@query("selector_summaries", "SELECT p_brand, p_type, count(*) AS rules FROM part GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 20 OFFSET 5")
def selector_summaries(spark, sf_dir) -> DataFrame:
    """A page of the rule counts by site and surface (the page is the feature)."""
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("rules")).orderBy("p_brand", "p_type").offset(5).limit(20)


@query("latest_jobs", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 2 = 0 ORDER BY o_orderkey DESC LIMIT 100")
def latest_jobs(spark, sf_dir) -> DataFrame:
    """The last hundred of a user's jobs (a top-k report)."""
    return table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select("o_orderkey", "o_orderstatus").orderBy(F.desc("o_orderkey")).limit(100)


@query("users_listed", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%1%' AND c_acctbal > 0 ORDER BY c_custkey LIMIT 25 OFFSET 25")
def users_listed(spark, sf_dir) -> DataFrame:
    """The second page of active users whose name has a text."""
    return table(spark, sf_dir, "customer").where((F.col("c_acctbal") > 0) & F.contains(F.lower("c_name"), F.lit("1"))).select("c_custkey", "c_name").orderBy("c_custkey").offset(25).limit(25)


@query("profiles_listed", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_type = 'PROMO' ORDER BY p_brand, p_partkey")
def profiles_listed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_type = 'PROMO'").select("p_partkey", "p_brand", "p_type").orderBy("p_brand", "p_partkey")


@query("settings_overlaid", """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, s.segment, 'none') AS segment, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END, s.balance, 0.0) AS balance
 FROM customer LEFT JOIN (SELECT s_nationkey, min(s_name) AS segment, CASE WHEN s_nationkey % 2 = 0 THEN max(s_acctbal) END AS balance FROM supplier GROUP BY s_nationkey) s ON c_nationkey = s_nationkey""")
def settings_overlaid(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    explicit = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("site"), F.when(key % 3 == 0, F.col("c_mktsegment")).alias("segment"), F.when(key % 4 == 0, F.col("c_acctbal")).alias("balance"))
    saved = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("site")).agg(F.min("s_name").alias("segment"), F.when(F.col("site") % 2 == 0, F.max("s_acctbal")).alias("balance"))
    return jobs.overlaid(explicit, saved, ["site"], ["segment", "balance"], {"segment": F.lit("none"), "balance": F.lit(0.0)}).drop("site")


@query("new_suggestions", "SELECT DISTINCT p_brand, p_type FROM part WHERE p_partkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM part o WHERE o.p_partkey % 7 = 1 AND o.p_brand = part.p_brand AND o.p_type = part.p_type)")
def new_suggestions(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return part.where("p_partkey % 3 = 0").join(part.where("p_partkey % 7 = 1"), ["p_brand", "p_type"], "left_anti").select("p_brand", "p_type").distinct()


@query("products_looked_up", "SELECT l_returnflag, count(*) AS n, count(p_partkey) AS found, count(*) FILTER (p_partkey IS NULL) AS failed FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 GROUP BY l_returnflag")
def products_looked_up(spark, sf_dir) -> DataFrame:
    """Products with their records in one join; those without one have failed."""
    found = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("found"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").join(found, "l_partkey", "left")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("found").alias("found"), F.count_if(F.col("found").isNull()).alias("failed"))


@query("latest_feedback", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_feedback(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return jobs.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("adapter_results_merged", """WITH r AS (SELECT l_suppkey AS adapter, l_partkey AS item, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag, CASE WHEN l_tax > 0.02 THEN l_linestatus ELSE ' ' END AS status, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
 s AS (SELECT adapter, count(*) AS n, count(flag) AS filled FROM r GROUP BY adapter), o AS (SELECT r.*, (-n, -filled, adapter, ord) AS k FROM r JOIN s USING (adapter))
 SELECT item, arg_min(flag, k) FILTER (trim(flag) <> '') AS flag, arg_min(status, k) FILTER (trim(status) <> '') AS status FROM o GROUP BY item""")
def adapter_results_merged(spark, sf_dir) -> DataFrame:
    """Adapters by how many records and filled fields they gave; each item's first value of a field in that order."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("adapter"), F.col("l_partkey").alias("item"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_tax") > 0.02, F.col("l_linestatus")).otherwise(" ").alias("status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    scores = rows.groupBy("adapter").agg((-F.count("*")).alias("less"), (-F.count("flag")).alias("emptier"))
    return jobs.merged_in_order(rows.join(scores, "adapter"), "item", ["less", "emptier", "adapter", "ord"], ["flag", "status"])


SALARIES = ['{"currency":"USD","value":{"minValue":"10","maxValue":"20","unitText":"HOUR"}}', '{"salaryCurrency":"EUR","value":{"value":"900"}}', '{"currencyCode":"GBP","value":"41 000"}', '{"value":{"minValue":"7"}}', '{"value":"5"}', '{"currency":"CHF"}', "{}", None, '{"currency":"USD","value":{"minValue":"{n}","unitText":"{w}"}}', '{"value":{"value":"{n}"}}', '{"currency":"EUR","value":"{n} {w}"}']


@query("salary_texts", f"""SELECT i, CASE WHEN n <> '' THEN concat_ws(' ', c, n, u) WHEN v2 <> '' AND v2 NOT LIKE '{{%' THEN concat_ws(' ', c, v2) END AS salary FROM (SELECT i, coalesce(v ->> '$.currency', v ->> '$.salaryCurrency', v ->> '$.currencyCode') AS c, coalesce(nullif(concat_ws(' - ', v ->> '$.value.minValue', v ->> '$.value.maxValue'), ''), v ->> '$.value.value') AS n, v ->> '$.value.unitText' AS u, v ->> '$.value' AS v2 FROM {values_sql(SALARIES)})""")
def salary_texts(spark, sf_dir) -> DataFrame:
    return given(spark, sf_dir, SALARIES).select("i", prices.salary_text(F.col("v")).alias("salary"))


BRANDS = ["Northwind™ lamp", "®Acme big chair", "plain chair", "One Two Three Four Five Six Seven™ x", "™", "", None, "Lumo® and Fjord™ set", "® Acme chair", "{w}™ {n}", "™ {w} {n}", "new {w} of {n}® parts", "{w}"]


@query("brand_markers", f"""SELECT i, CASE WHEN len(list_filter(regexp_split_to_array(lower(b), '[^a-z0-9]+'), lambda t: t <> '')) <= {text.BRAND_WORDS} THEN nullif(b, '') END AS brand FROM (SELECT i, CASE WHEN regexp_matches(v, '^[™®]') THEN nullif(CASE WHEN v[2] = ' ' THEN v[1] || split_part(v[3:], ' ', 1) ELSE split_part(v, ' ', 1) END, v) ELSE trim(regexp_extract(v, '^[^™®]*[™®]')) END AS b FROM {values_sql(BRANDS)})""")
def brand_markers(spark, sf_dir) -> DataFrame:
    return given(spark, sf_dir, BRANDS).select("i", text.marked_brand(F.col("v")).alias("brand"))


@query("attributes_present", "SELECT p_partkey, array_to_string(list_filter(['p_brand', CASE WHEN p_size > 10 THEN 'p_size' END, CASE WHEN p_type = 'PROMO' THEN 'p_type' END], lambda x: x IS NOT NULL), '|') AS present, array_to_string(list_filter([CASE WHEN p_size <= 10 THEN 'p_size' END, CASE WHEN p_type <> 'PROMO' THEN 'p_type' END], lambda x: x IS NOT NULL), '|') AS absent FROM part")
def attributes_present(spark, sf_dir) -> DataFrame:
    names = F.array(*map(F.lit, ["p_brand", "p_size", "p_type"]))
    data = F.create_map(F.lit("p_brand"), F.col("p_brand"), F.lit("p_size"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")), F.lit("p_type"), F.when(F.col("p_type") == "PROMO", F.col("p_type")))
    absent = records.coverage(names, data)["missing"]
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_except(names, absent), "|").alias("present"), F.array_join(absent, "|").alias("absent"))


@query("export_rows_checked", r"SELECT page_id, regexp_matches(url, '^https?://[^/]') AND page_id % 5 <> 0 AS valid FROM pages")
def export_rows_checked(spark, sf_dir) -> DataFrame:
    """A row of the export contract has an absolute address and no field beside the contract's."""
    extra = F.array(F.lit("title"), F.when(F.col("page_id") % 5 == 0, "debug").otherwise("price"))
    valid = (urls.host_of(F.col("url")) != "") & F.col("url").rlike("^https?://[^/]") & (F.size(F.array_except(extra, F.array(F.lit("title"), F.lit("price")))) == 0)
    return table(spark, sf_dir, "pages").select("page_id", valid.alias("valid"))


@query("rules_unnested", "SELECT p_brand, p_type AS field, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1, 2")
def rules_unnested(spark, sf_dir) -> DataFrame:
    """A site's map of rules as one row a rule."""
    memory = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("rules"))
    return memory.select("p_brand", F.explode("rules").alias("field", "n"))


@query("enrichment_selection", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS taken, count(*) FILTER (o_orderstatus = 'O') AS done_before, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS skipped FROM orders GROUP BY 1")
def enrichment_selection(spark, sf_dir) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(status == "F").alias("taken"), F.count_if(status == "O").alias("done_before"), F.count_if(~status.isin("F", "O")).alias("skipped"))


@query("candidates_united", "SELECT name, count(*) AS n FROM (SELECT lower(c_name) AS name FROM customer UNION ALL SELECT lower(s_name) FROM supplier UNION ALL SELECT lower(c_name) FROM customer WHERE c_custkey % 2 = 0) GROUP BY name")
def candidates_united(spark, sf_dir) -> DataFrame:
    """Generic records and adapters' as one bag: repeated ones stay."""
    one, two = table(spark, sf_dir, "customer").select(F.lower("c_name").alias("name"), "c_custkey"), table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("name"))
    return one.select("name").unionByName(two).unionByName(one.where("c_custkey % 2 = 0").select("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("contract_outcomes", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 3 = 0 THEN 'success' WHEN o_orderkey % 3 = 1 THEN 'failure' ELSE 'neither' END AS outcome FROM orders) GROUP BY outcome")
def contract_outcomes(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    verdict = F.when(key % 3 == 0, "success").when(key % 3 == 1, "listing_detection_failed").otherwise("empty")
    return table(spark, sf_dir, "orders").groupBy(jobs.outcome(key % 4, key % 5 == 0, verdict).alias("outcome")).agg(F.count("*").alias("n"))
