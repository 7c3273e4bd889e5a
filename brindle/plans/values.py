"""Queries of value functions over texts that the parts write, and of rules over the tables; each with SQL of its own making."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import numbers, prices, text, urls
from brindle.operators import matching, ranking, records
from brindle.plans.registry import query, table


def given(spark: SparkSession, sf_dir: str, values: list[str | None]) -> DataFrame:
    """(i, v): each part writes the text that its turn is at, with its own size for {n} and its own kind of thing for {w}."""
    own, key = F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int")), F.col("p_partkey")
    filled = F.replace(F.replace(own, F.lit("{n}"), F.col("p_size").cast("string")), F.lit("{w}"), F.split_part("p_name", F.lit(" "), F.lit(2)))
    return table(spark, sf_dir, "part").select(key.alias("i"), filled.alias("v"))


def values_sql(values: list[str | None]) -> str:
    """The same rows in SQL."""
    return f"(SELECT p_partkey AS i, replace(replace(t.v, '{{n}}', CAST(p_size AS VARCHAR)), '{{w}}', split_part(p_name, ' ', 2)) AS v FROM part JOIN {_numbered(values)} t ON t.i = p_partkey % {len(values)})"


def _numbered(values: list[str | None]) -> str:
    rows = ", ".join(f"({i}, {'NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)})" for i, v in enumerate(values))
    return f"(SELECT i::INTEGER AS i, v::VARCHAR AS v FROM (VALUES {rows}) t(i, v))"


PRICES = [
    "84", "$84", "Rs 310", "Rs. 310", "SEK 7", "now 45", "mrp 9", "19.75", "31,40 kr", "31,4 kr", "8,125", "€23.000", "2.345,60 EUR", "2,345.60", "4.567.890", "-12.50", "- £3", "-USD900.25", "-Rs. 5",
    "+77.10", "3,2,1", "1.22.3", "00450", "only 4 left", "", "  ", None, "free", "from 6", "CHF 1'200", "12..", "$1,000,000",
    "${n}.50", "€{n}.000", "{n} EUR", "Rs {n}", "{w} {n}", "now {n},9{n}", "-${n}", "{n}.{n}.{n}",
]


@query("price_texts", f"""WITH t AS (SELECT i, v, regexp_replace(trim(v), '\\s+', ' ', 'g') AS s FROM {values_sql(PRICES)}), n AS (SELECT *, rtrim(regexp_extract(s, '[-+]?[0-9][0-9.,]*'), '.,') AS n FROM t),
 p AS (SELECT *, len(n) - strpos(reverse(n), ',') + 1 AS comma, len(n) - strpos(reverse(n), '.') + 1 AS dot FROM n),
 c AS (SELECT *, CASE WHEN contains(n, ',') AND contains(n, '.') THEN CASE WHEN comma > dot THEN replace(replace(n, '.', ''), ',', '.') ELSE replace(n, ',', '') END
  WHEN contains(n, ',') THEN CASE WHEN len(n) - comma IN (1, 2) THEN replace(n[:comma - 1], ',', '') || '.' || n[comma + 1:] ELSE replace(n, ',', '') END
  WHEN regexp_full_match(n, '[-+]?[0-9]+(\\.[0-9][0-9][0-9])+') THEN replace(n, '.', '') ELSE n END AS c FROM p), d AS (SELECT *, CASE WHEN contains(c, '.') THEN coalesce(nullif(ltrim(split_part(ltrim(c, '+'), '.', 1), '0'), ''), '0') || substr(c, strpos(c, '.')) ELSE coalesce(nullif(ltrim(ltrim(c, '+'), '0'), ''), '0') END AS d FROM c)
 SELECT i, CASE WHEN v IS NULL OR NOT regexp_full_match(ltrim(c, '+'), '[0-9]+(\\.[0-9]+)?') OR s LIKE '-%' THEN NULL WHEN NOT contains(d, '.') AND len(d) <= 3 AND NOT (regexp_matches(s, '[$€£¥₹]') OR len(list_filter(regexp_split_to_array(lower(s), '[^a-z]+'), lambda w: w IN ('cost', 'from', 'mrp', 'msrp', 'now', 'price', 'sale', 'starting', 'rs', {', '.join(repr(c.lower()) for c in prices.CODES)}))) > 0) THEN NULL ELSE d END AS price FROM d""")
def price_texts(spark, sf_dir) -> DataFrame:
    return given(spark, sf_dir, PRICES).select("i", prices.decimal_price(F.col("v")).alias("price"))


STATES = ["In Stock", "only 3 left in stock", "Low stock", "oos", "Ready to ship", "https://schema.org/PreOrder", "schema.org/LimitedAvailability/", "Currently Unavailable", "pre-order today", "limited-stock", "YES", "0", "ask in shop", " back-order ", "OutOfStock", "http://schema.org/InStock", "only", "soldout", None, "", "only {n} left in stock", "{w} sold out", "{n}", "{w} ready to ship"]


@query("availability_states", f"""WITH t AS (SELECT i, regexp_replace(trim(v), '\\s+', ' ', 'g') AS s FROM {values_sql(STATES)}),
 w AS (SELECT * FROM (VALUES ('in stock','in_stock'),('instock','in_stock'),('available','in_stock'),('ready to ship','in_stock'),('limited stock','limited_stock'),('limitedstock','limited_stock'),('low stock','limited_stock'),('lowstock','limited_stock'),('only','limited_stock'),('left in stock','limited_stock'),('out of stock','out_of_stock'),('outofstock','out_of_stock'),('oos','out_of_stock'),('sold out','out_of_stock'),('unavailable','out_of_stock'),('pre-order','preorder'),('preorder','preorder'),('backorder','preorder'),('back-order','preorder')) w(phrase, own)),
 f AS (SELECT i, arg_max(own, len(phrase)) AS own FROM t JOIN w ON contains(lower(s), phrase) GROUP BY i)
 SELECT i, CASE regexp_replace(rtrim(lower(s), '/'), '^(https?://)?schema\\.org/', '') WHEN 'instock' THEN 'in_stock' WHEN 'outofstock' THEN 'out_of_stock' WHEN 'limitedavailability' THEN 'limited_stock' WHEN 'preorder' THEN 'pre_order'
 ELSE CASE WHEN translate(lower(s), '- ', '__') IN ('in_stock', 'out_of_stock', 'limited_stock', 'preorder') THEN translate(lower(s), '- ', '__') WHEN lower(s) IN ('true', '1', 'yes') THEN 'in_stock' WHEN lower(s) IN ('false', '0', 'no') THEN 'out_of_stock' ELSE coalesce(own, s) END END AS state FROM t LEFT JOIN f USING (i)""")
def availability_states(spark, sf_dir) -> DataFrame:
    return given(spark, sf_dir, STATES).select("i", prices.availability(F.col("v")).alias("state"))


NUMBERS = ["1,234", "1.234,56", "1,234.56", "12", "a 7 b", "", None, "1,2,3", "12,3456", "1.2.3", ".5", "9.", "x", "USD 1 000", "-5", "3e2", " 42 ", "4.99", "-4.99", "+8", "1e400", "1,000 items", "99999999999999999999", "2.675", "4.125", "4.135", "true", "Fully  Remote", "OFFICE", "{n},500", "{n}.25 of {w}", "{n}", "-{n}.75", "{n}e1", "{w}"]


@query("loose_numbers", f"""WITH t AS (SELECT i, v, regexp_replace(v, '[^0-9.,]+', '', 'g') AS k FROM {values_sql(NUMBERS)}), p AS (SELECT *, strpos(reverse(k), ',') AS c, strpos(reverse(k), '.') AS d FROM t),
 n AS (SELECT *, CASE WHEN c > 0 AND d > 0 THEN CASE WHEN c < d THEN replace(replace(k, '.', ''), ',', '.') ELSE replace(k, ',', '') END WHEN c BETWEEN 2 AND 4 THEN replace(k[:len(k) - c], ',', '') || '.' || k[len(k) - c + 2:] ELSE replace(k, ',', '') END AS n,
  regexp_extract(replace(v, ',', ''), '[-+]?[0-9][0-9.]*') AS f FROM p)
 SELECT i, CASE WHEN regexp_full_match(n, '[0-9]+\\.?[0-9]*|\\.[0-9]+') THEN n::DOUBLE END AS loose, CASE WHEN regexp_full_match(f, '[-+]?[0-9]+\\.?[0-9]*') THEN try_cast(split_part(f, '.', 1) AS BIGINT) END AS first_int,
 CASE WHEN regexp_full_match(trim(v), '[-+]?[0-9]+') AND try_cast(trim(v) AS BIGINT) IS NOT NULL THEN try_cast(trim(v) AS BIGINT) WHEN regexp_full_match(trim(v), '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') THEN coalesce(try_cast(trunc(try_cast(trim(v) AS DOUBLE)) AS BIGINT), 0) ELSE 0 END AS as_int,
 CASE WHEN regexp_full_match(trim(v), '[-+]?[0-9]+(\\.[0-9]+)?') THEN CAST(round_even(try_cast(trim(v) AS DECIMAL(18,6)), 2) AS DOUBLE) END AS rating,
 CASE WHEN regexp_replace(lower(trim(v)), '\\s+', ' ', 'g') IN ('true', 'fully remote', '1') THEN TRUE WHEN lower(trim(v)) = 'office' THEN FALSE END AS remote FROM n""")
def loose_numbers(spark, sf_dir) -> DataFrame:
    v = F.col("v")
    return given(spark, sf_dir, NUMBERS).select("i", numbers.loose_float(v).alias("loose"), numbers.first_int(v).alias("first_int"), numbers.as_int(v).alias("as_int"), numbers.rating(v).alias("rating"), numbers.yes_or_no(v).alias("remote"))


TIMES = ["2024-03-01T10:20:30Z", "2024-03-01T10:20:30+02:00", "2024-03-01T10:20:30.250-05:30", "2024-03-01 10:20", "2024-03-01", "2024-02-30T00:00:00Z", "yesterday", "", None, " 2024-12-31T23:59:59+00:00 ", "2024-03-{n}", "2024-01-01T10:20:30.{n}Z", "{w}"]


@query("saved_times", f"""SELECT i, CASE WHEN regexp_full_match(s, '[0-9-]{{10}}([T ].*)?') THEN CASE WHEN regexp_matches(s, ':[0-9.]+(Z|[+-][0-9:]+)$') THEN try_cast(s AS TIMESTAMPTZ) AT TIME ZONE 'UTC' ELSE try_cast(s AS TIMESTAMP) END END AS saved FROM (SELECT i, trim(v) AS s FROM {values_sql(TIMES)})""")
def saved_times(spark, sf_dir) -> DataFrame:
    return given(spark, sf_dir, TIMES).select("i", numbers.saved_at(F.col("v")).alias("saved"))


TOKENS = ["was $30.00 now $24.50", "24,50 € statt 30 €", "USD 15 or eur 14", "15 inr", "just 12", "£ 9", None, "", "AUDIO 5", "price ₹1,200", "${n} then €{n}.10", "{w} {n} USD", "{n} {w}"]


@query("price_tokens", f"""SELECT i, CASE WHEN len(a) > 0 THEN a[-1] WHEN len(c) > 0 THEN c[-1] END AS last, CASE WHEN len(a) > 0 THEN a[1] WHEN len(c) > 0 THEN c[1] END AS first FROM (SELECT i,
 regexp_extract_all(v, '[$€£¥₹]\\s*[0-9][0-9.,]*|[0-9][0-9.,]*\\s*[$€£¥₹]') AS a, regexp_extract_all(upper(v), '\\b(?:USD|EUR|GBP|INR|JPY|CAD|AUD)\\b\\s*[0-9][0-9.,]*|[0-9][0-9.,]*\\s*\\b(?:USD|EUR|GBP|INR|JPY|CAD|AUD)\\b') AS c FROM {values_sql(TOKENS)})""")
def price_tokens(spark, sf_dir) -> DataFrame:
    return given(spark, sf_dir, TOKENS).select("i", numbers.price_token(F.col("v")).alias("last"), numbers.price_token(F.col("v"), False).alias("first"))


RATES = {"USD": 1.0, "EUR": 1.1, "GBP": 1.25, "INR": 0.012}


@query("prices_in_dollars", """SELECT o_orderkey, o_totalprice * CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.1 WHEN 2 THEN 1.25 WHEN 3 THEN 0.012 END::DOUBLE AS usd FROM orders""")
def prices_in_dollars(spark, sf_dir) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ["usd", "EUR", "GBP", "INR", "XXX"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", prices.amount_usd(F.col("o_totalprice"), code, RATES).alias("usd"))


SKUS = ["AB-12", " 77 ", "{\"a\":1}", "a1b2c3d4e5f6a7b8c9d0e1", "abcdefghijklmnopqrstuvwx", "", None, "[x]", "{w}-{n}", "draft-{w}{n}", "TMP__10000000{n}00", "test_[{n}]", "copy-", "{w}{w}{w}{w}{w}{n}"]


@query("skus_checked", f"""SELECT i, CASE WHEN c = '' OR left(c, 1) IN ('{{', '[') OR (c <> trim(v) AND len(c) >= 10 AND NOT regexp_matches(c, '[^0-9]')) OR (len(c) > 20 AND regexp_full_match(c, '[A-Za-z0-9]+') AND regexp_matches(c, '[A-Za-z]') AND regexp_matches(c, '[0-9]')) THEN NULL ELSE c END AS sku
 FROM (SELECT i, v, trim(regexp_replace(trim(v), '(?i)^(copy|draft|tmp|temp|test)[-_]+', '')) AS c FROM {values_sql(SKUS)})""")
def skus_checked(spark, sf_dir) -> DataFrame:
    return given(spark, sf_dir, SKUS).select("i", prices.sku(F.col("v")).alias("sku"))


TITLES = ["My  Account", "Gift cards", "gift card - 20", "Helpful lamp", "Help", "Oak table", "Terms & conditions", "cartoon mug", "", None, "About\tus today", "{w} help", "help{w}", "My {w} account", "{w} gift card {n}"]


@query("utility_titles", f"""SELECT i, coalesce(bool_or(regexp_matches(regexp_replace(lower(trim(v)), '\\s+', ' ', 'g'), '(^|[^a-z0-9])' || p || '([^a-z0-9]|$)')), FALSE) AS utility FROM {values_sql(TITLES)}, (SELECT unnest([{", ".join(repr(x) for x in text.UTILITY_TITLES)}]) AS p) GROUP BY i""")
def utility_titles(spark, sf_dir) -> DataFrame:
    return given(spark, sf_dir, TITLES).select("i", text.utility_title(F.col("v")).alias("utility"))


LINKS = ["a.html", "../x/y?z=1#f", "/root/./p/../q", "//cdn.example.net/i.png", "?page=2", "#part", "https://other.example/a b", "../../../up", "./", "", "mailto:a@b.example", "deep/er/..", "{w}/{n}.html", "../{w}?n={n}", "www.{w}.example/{n}", "{w}.com", "/{w}/../{n}"]
BASE = "https://shop.example.com/en/list/page.html?sort=up#top"


@query("links_resolved", f"""WITH t AS (SELECT i, v, regexp_extract(v, '^[^?#]*') AS p FROM {values_sql(LINKS)}), m AS (SELECT i, v, p, CASE WHEN p LIKE '/%' THEN p ELSE '/en/list/' || p END AS m FROM t),
 d AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(replace(m || '/', '/./', '/'), '/./', '/'), '/[^/.]+/\\.\\./', '/'), '/[^/.]+/\\.\\./', '/'), '^(/\\.\\.)+/', '/') AS d FROM m)
 SELECT i, CASE WHEN v = '' THEN '' WHEN regexp_matches(v, '^[a-z]+:') THEN v WHEN v LIKE '//%' THEN 'https:' || v WHEN regexp_matches(v, '^(www\\.[^/]+\\.|[^/.]+\\.com$)') THEN 'https://' || v WHEN v LIKE '#%' THEN 'https://shop.example.com/en/list/page.html?sort=up' || v WHEN v LIKE '?%' THEN 'https://shop.example.com/en/list/page.html' || v
 ELSE 'https://shop.example.com' || CASE WHEN m LIKE '%/' OR m LIKE '%/..' OR m LIKE '%/.' THEN d.d[:len(d.d) - CASE WHEN m LIKE '%/' AND d.d LIKE '%//' THEN 1 ELSE 0 END] ELSE d.d[:len(d.d) - 1] END || v[len(p) + 1:] END AS url, regexp_matches(v, '^(//cdn|https://other|www|[^/.]+\\.com$)') = FALSE AND NOT v LIKE 'mailto:%' AND v <> '' AS same_site FROM d""")
def links_resolved(spark, sf_dir) -> DataFrame:
    url = urls.absolute_url(F.lit(BASE), F.col("v"))
    return given(spark, sf_dir, LINKS).select("i", url.alias("url"), F.coalesce(urls.same_host(F.lit(BASE), url) & (F.trim("v") != "") & ~F.col("v").startswith("mailto:"), F.lit(False)).alias("same_site"))


@query("pasted_targets", f"""WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '  ' || replace(url, '&', '&amp;') || ' ' WHEN 1 THEN url || ' ' || url WHEN 2 THEN url ELSE '   ' END AS v FROM pages), u AS (SELECT page_id, replace(trim(v), '&amp;', '&') AS url FROM t)
 SELECT page_id, CASE WHEN regexp_matches(url, '\\s') OR url = '' THEN '' ELSE {urls.SQL['stripped']} END AS target FROM u""")
def pasted_targets(spark, sf_dir) -> DataFrame:
    url, key = F.col("url"), F.col("page_id") % 4
    pasted = F.when(key == 0, F.concat(F.lit("  "), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit(" "))).when(key == 1, F.concat(url, F.lit(" "), url)).when(key == 2, url).otherwise("   ")
    return table(spark, sf_dir, "pages").select("page_id", urls.target_url(pasted).alias("target"))


HOSTS = ["www.amazon.de", "smile.amazon.co.uk", "badamazon.com", "etsy.com", "shop.northwind.example", "northwind.example", "compare.example", "big.store.example", "notetsy.com", "", "Flipkart.com", "{w}.northwind.example", "{w}.example", "{w}.store.example", "{w}etsy.com"]


@query("source_types", f"""SELECT i, CASE WHEN h = 'northwind.example' OR h LIKE '%.northwind.example' THEN 'brand_dtc' WHEN regexp_matches(h, '(^|\\.)({"|".join(x.replace(".", chr(92) + ".") for x in urls.MARKETPLACES)})$') THEN 'marketplace' WHEN regexp_matches(h, '(^|\\.)compare\\.example$') THEN 'aggregator' WHEN regexp_matches(h, '(^|\\.)store\\.example$') THEN 'retailer' ELSE 'unknown' END AS kind FROM (SELECT i, regexp_replace(lower(v), '^www\\.', '') AS h FROM {values_sql(HOSTS)})""")
def source_types(spark, sf_dir) -> DataFrame:
    return given(spark, sf_dir, HOSTS).select("i", urls.source_type(F.col("v"), F.lit("northwind.example"), ["compare.example"], ["store.example"]).alias("kind"))


@query("verdicts_of_urls", """SELECT o_orderkey, CASE WHEN n > 0 THEN CASE WHEN blocked THEN 'partial' ELSE 'success' END WHEN blocked THEN 'blocked' WHEN listing THEN 'listing_detection_failed' ELSE 'empty' END AS verdict FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS listing, o_orderstatus = 'P' AS blocked, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey)""")
def verdicts_of_urls(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(n, "o_orderkey", "left")
    return rows.select("o_orderkey", records.verdict(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus") == "P", F.coalesce("n", F.lit(0))).alias("verdict"))


STATUSES = ["pending", "running", "paused", "completed", "killed", "failed", "proxy_exhausted", "Cancelled", "degraded", "odd"]


@query("transitions_checked", f"""WITH s AS (SELECT * FROM {_numbered(STATUSES)}), n AS (SELECT i, CASE lower(v) WHEN 'cancelled' THEN 'killed' WHEN 'degraded' THEN 'failed' WHEN 'odd' THEN NULL ELSE lower(v) END AS v FROM s),
 e AS (SELECT event_id, a.v AS a, b.v AS b FROM events JOIN n a ON a.i = event_id % 10 JOIN n b ON b.i = user_id % 10)
 SELECT a AS current, b AS target, count(*) AS n, coalesce(a = b OR (a || '>' || b) IN ('pending>running', 'pending>killed', 'running>paused', 'running>completed', 'running>killed', 'running>failed', 'running>proxy_exhausted', 'paused>running', 'paused>killed'), FALSE) AS legal FROM e GROUP BY a, b""")
def transitions_checked(spark, sf_dir) -> DataFrame:
    at = lambda c: F.element_at(F.array(*map(F.lit, STATUSES)), (F.col(c) % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(records.run_status(at("event_id")).alias("current"), records.run_status(at("user_id")).alias("target"))
    return rows.groupBy("current", "target").agg(F.count("*").alias("n")).select("current", "target", "n", records.legal_transition(F.col("current"), F.col("target")).alias("legal"))


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_brand").alias("page"), (key % 4).cast("int").alias("set"), (key * 7 % 31 - 4).cast("int").alias("score"), (key % 3 == 0).alias("supported"),
        (key % 5 < 2).alias("detail_like"), (key % 11 == 0).alias("utility"), (key % 2 == 0).alias("detail_merchandise"), (key % 13 < 5).alias("fallback_merchandise"), (key % 7 == 0).alias("job"),
    )


_LISTINGS = "SELECT p_partkey AS id, p_brand AS page, CAST(p_partkey % 4 AS INTEGER) AS set, CAST(p_partkey * 7 % 31 - 4 AS INTEGER) AS score, p_partkey % 3 = 0 AS supported, p_partkey % 5 < 2 AS detail_like, p_partkey % 11 = 0 AS utility, p_partkey % 2 = 0 AS detail_merchandise, p_partkey % 13 < 5 AS fallback_merchandise, p_partkey % 7 = 0 AS job FROM part"


@query("listings_dropped", f"""SELECT id, CASE WHEN score < 0 THEN TRUE WHEN detail_like THEN (utility AND score < 10) OR NOT (supported OR job OR detail_merchandise) ELSE utility OR NOT (supported OR (score >= 10 AND (job OR fallback_merchandise))) END AS dropped FROM ({_LISTINGS})""")
def listings_dropped(spark, sf_dir) -> DataFrame:
    return _listings(spark, sf_dir).select("id", ranking.dropped(*map(F.col, ("score", "supported", "detail_like", "utility", "detail_merchandise", "fallback_merchandise", "job"))).alias("dropped"))


@query("best_listing_sets", f"""WITH s AS (SELECT page, set, count(*) FILTER (score >= 18) AS strong, count(*) FILTER (supported) AS supported, count(*) FILTER (detail_like) AS detail_like, count(*) FILTER (NOT utility) AS clean, CAST(round_even(sum(score) / count(*) * 100, 0) AS BIGINT) AS mean, -count(*) FILTER (utility) AS utility, CAST(sum(score) AS BIGINT) AS total FROM ({_LISTINGS}) GROUP BY page, set)
 SELECT page, set, strong, supported, mean, total FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY strong DESC, supported DESC, detail_like DESC, clean DESC, mean DESC, utility DESC, total DESC, set) AS r FROM s) WHERE r = 1""")
def best_listing_sets(spark, sf_dir) -> DataFrame:
    best = ranking.best_sets(ranking.set_scores(_listings(spark, sf_dir), ["page", "set"]), "page", "set")
    return best.select("page", "set", "rank.strong", "rank.supported", "rank.mean", "rank.total")


@query("best_clusters", f"""SELECT page, id, score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, set, id) AS r FROM ({_LISTINGS})) WHERE r = 1""")
def best_clusters(spark, sf_dir) -> DataFrame:
    return ranking.best_per_link(_listings(spark, sf_dir), "page", "score", ["set", "id"]).select("page", "id", "score")


@query("exact_categories", """WITH c AS (SELECT DISTINCT lower(p_type) || ' > ' || split_part(p_name, ' ', 2) AS path, split_part(p_name, ' ', 2) AS leaf FROM part), l AS (SELECT leaf, min(path) AS path FROM c GROUP BY leaf HAVING count(*) = 1),
 p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) || '  >  ' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 2) END AS v FROM part), n AS (SELECT p_partkey, regexp_replace(lower(trim(v)), '\\s+', ' ', 'g') AS v FROM p)
 SELECT p_partkey, coalesce(c.path, l.path) AS category, CASE WHEN c.path IS NOT NULL THEN 1.0 ELSE 0.92 END::DOUBLE AS score FROM n LEFT JOIN c ON lower(c.path) = n.v LEFT JOIN l ON lower(l.leaf) = n.v WHERE c.path IS NOT NULL OR l.path IS NOT NULL""")
def exact_categories(spark, sf_dir) -> DataFrame:
    part, leaf = table(spark, sf_dir, "part"), F.split_part("p_name", F.lit(" "), F.lit(2))
    taxonomy = part.select(F.concat(F.lower("p_type"), F.lit(" > "), leaf).alias("category"), leaf.alias("leaf")).distinct()
    value = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_type"), F.lit("  >  "), leaf)).otherwise(leaf)
    return matching.exact_category(part.select("p_partkey", value.alias("value")), taxonomy, "p_partkey")


@query("variant_identities", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'id:' || p_partkey WHEN p_partkey % 4 = 1 THEN 'sku:' || p_brand WHEN p_partkey % 4 = 2 THEN 'options:color=' || p_type || '|size=' || p_size END AS identity FROM part""")
def variant_identities(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    options = F.when(key % 4 == 2, F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("color"), F.concat(F.lit(" "), F.col("p_type")), F.lit("empty"), F.lit(" "))).otherwise(F.create_map(F.lit("size"), F.lit("")))
    own = records.variant_identity(F.when(key % 4 == 0, key.cast("string")), F.when(key % 4 == 1, F.col("p_brand")).otherwise(" "), options)
    return table(spark, sf_dir, "part").select("p_partkey", own.alias("identity"))


@query("images_distinct", """SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: lower(x) <> 'a.jpg' AND x <> '' AND len(list_filter(l[:i - 1], lambda y: lower(y) = lower(x))) = 0), '|') AS images FROM (SELECT p_partkey, ['A.jpg', 'b' || (p_partkey % 3) || '.png', '', 'B1.png', lower(p_type) || '.gif', p_type || '.gif'] AS l FROM part)""")
def images_distinct(spark, sf_dir) -> DataFrame:
    images = F.array(F.lit("A.jpg"), F.concat(F.lit("b"), (F.col("p_partkey") % 3).cast("string"), F.lit(".png")), F.lit(""), F.lit("B1.png"), F.concat(F.lower("p_type"), F.lit(".gif")), F.concat("p_type", F.lit(".gif")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(records.other_images(images, F.lit("a.jpg")), "|").alias("images"))


@query("fields_covered", """SELECT p_partkey, CAST(3 AS INTEGER) AS requested, CAST(3 - len(m) AS INTEGER) AS found, array_to_string(m, '|') AS missing FROM (SELECT p_partkey, list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'title' END, CASE WHEN p_partkey % 3 = 0 THEN 'price' END, CASE WHEN p_size > 10 THEN 'size' END], lambda x: x IS NOT NULL) AS m FROM part)""")
def fields_covered(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    data = F.create_map(F.lit("title"), F.when(key % 2 == 1, F.col("p_name")), F.lit("price"), F.when(key % 3 != 0, F.col("p_retailprice").cast("string")).otherwise(" "), F.lit("size"), F.when(F.col("p_size") <= 10, F.col("p_size").cast("string")))
    c = records.coverage(F.array(*map(F.lit, ["title", "price", "size"])), data)
    return table(spark, sf_dir, "part").select("p_partkey", c["requested"].alias("requested"), c["found"].alias("found"), F.array_join(c["missing"], "|").alias("missing"))


@query("records_in_contract", """SELECT p_partkey, 'brand=' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '|price=' || p_size ELSE '|price=' || p_type END || '|title=' || p_name AS fields FROM part""")
def records_in_contract(spark, sf_dir) -> DataFrame:
    """Aliases to canonical fields; a canonical name beats its aliases, unknown and internal ones go."""
    price = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string"))
    data = F.create_map(F.lit("sale_price"), F.col("p_type"), F.lit("price"), price, F.lit("name"), F.col("p_name"), F.lit("manufacturer"), F.col("p_brand"), F.lit("_trace"), F.lit("x"), F.lit("colour of box"), F.lit("y"))
    own = records.to_contract(data, records.surface_fields(["title", "price", "brand"], ["url"]), {"sale_price": "price", "name": "title", "manufacturer": "brand"})
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(own)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return table(spark, sf_dir, "part").select("p_partkey", listed.alias("fields"))


@query("run_progress", """SELECT o_custkey, count(*) AS done, CAST(sum(n) AS BIGINT) AS records, CAST(floor(100.0 * count(*) / greatest(count(*), 20)) AS INTEGER) AS progress, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def run_progress(spark, sf_dir) -> DataFrame:
    """A run's progress out of 20 planned addresses, with its records and verdict counts; line items are counted before the join."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(n, "o_orderkey")
    return records.progress(rows, "o_custkey", "n", "o_orderstatus", F.lit(20), {"f": "F", "o": "O"})


@query("populated_means", """SELECT p_brand, avg(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END)::DOUBLE AS populated FROM part GROUP BY p_brand""")
def populated_means(spark, sf_dir) -> DataFrame:
    data = F.create_map(F.lit("title"), F.col("p_name"), F.lit("url"), F.lit("u"), F.lit("size"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")), F.lit("type"), F.col("p_type"), F.lit("none"), F.lit(" "))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg(records.populated(data)).alias("populated"))


@query("search_queries", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN b <> '' AND p_partkey % 2 = 0 THEN '"' || b || '" "' || t || '" site:northwind.example -site:old.example' END, CASE WHEN b <> '' AND p_partkey % 3 = 0 THEN '"' || b || '" "' || t || '" "' || p_size || '" -site:old.example' END,
 CASE WHEN b <> '' THEN '"' || b || '" "' || t || '" buy -site:old.example' END, CASE WHEN p_partkey % 3 = 0 THEN '"' || t || '" "' || p_size || '" -site:old.example' END, '"' || t || '" buy -site:old.example'], lambda x: x IS NOT NULL), chr(10)) AS queries FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) END AS b, p_name AS t FROM part)""")
def search_queries(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    brand = F.when(key % 5 == 0, F.lit("")).otherwise(matching.brand_key(F.col("p_brand"), {}))
    own = matching.search_queries(brand, F.col("p_name"), F.when(key % 3 == 0, F.col("p_size").cast("string")), F.when(key % 2 == 0, F.lit("northwind.example")), F.lit("old.example"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(own, "\n").alias("queries"))
