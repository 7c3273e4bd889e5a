"""Queries over structured documents, layouts, rules and versions; parts, orders and events are written as what they would come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import prices, urls
from brindle.operators import links, prefix
from brindle.plans.registry import query, table
from brindle.sources import structured

U = urls.SQL


@query("json_ld_records", """SELECT p_partkey, 0 AS position, 'Product' AS type, p_name AS name FROM part WHERE p_partkey % 4 < 3
 UNION ALL SELECT p_partkey, 1, 'Offer', NULL FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT p_partkey, 1, 'Brand', p_brand FROM part WHERE p_partkey % 4 = 2""")
def json_ld_records(spark, sf_dir) -> DataFrame:
    """JSON-LD as one object, a list, a graph, or broken."""
    product = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name")))
    brand = F.to_json(F.struct(F.lit("Brand").alias("@type"), F.col("p_brand").alias("name")))
    form = F.col("p_partkey") % 4
    body = F.when(form == 0, product).when(form == 1, F.concat(F.lit('[{"@type":"Offer"},'), product, F.lit("]"))).when(form == 2, F.concat(F.lit('{"@graph":['), brand, F.lit(","), product, F.lit("]}"))).otherwise('{"@type": broken')
    html = F.concat(F.lit('<html><script type="application/ld+json">'), body, F.lit("</script></html>"))
    nodes = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(structured.json_ld_nodes(html)).alias("position", "node"))
    return nodes.select("p_partkey", "position", F.get_json_object("node", "$['@type']").alias("type"), F.get_json_object("node", "$.name").alias("name"))


@query("opengraph_fields", """SELECT p_partkey, u.f AS field, u.v AS value FROM (SELECT p_partkey, unnest([{'f': 'title', 'v': p_name}, {'f': 'price', 'v': CAST(p_size AS VARCHAR)}, {'f': 'type', 'v': p_type}, {'f': 'image_url', 'v': CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'http://i/' || p_partkey END}]) AS u FROM part) WHERE u.v <> ''""")
def opengraph_fields(spark, sf_dir) -> DataFrame:
    tag = lambda k, v: F.concat(F.lit(f'<meta property="og:{k}" content="'), v, F.lit('"/>'))
    image = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("http://i/"), F.col("p_partkey").cast("string")))
    html = F.concat(tag("title", F.col("p_name")), tag("price:amount", F.col("p_size").cast("string")), tag("type", F.col("p_type")), tag("image", image))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(structured.opengraph(html)).alias("p")).select("p_partkey", "p.field", "p.value")


_LAST = "trim(regexp_replace(regexp_replace(regexp_extract(url, '/([^/?#]+)/?(?:[?#].*)?$', 1), '\\.[a-z]+$', ''), '[-_]+', ' ', 'g'))"


@query("sitemap_locations", f"SELECT page_id, CAST(0 AS INTEGER) AS position, url, {_LAST} AS title FROM (SELECT page_id, trim(url) AS url FROM pages) UNION ALL SELECT page_id, 1, 'http://more/' || page_id || '/some-page_x.html', 'some page x' FROM pages")
def sitemap_locations(spark, sf_dir) -> DataFrame:
    own = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    loc = lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))
    more = F.concat(F.lit("http://more/"), F.col("page_id").cast("string"), F.lit("/some-page_x.html"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), loc(own), loc(more), loc(own), loc(F.lit("no address")), F.lit("</urlset>"))
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(structured.sitemap_urls(xml)).alias("position", "url"))
    return found.select("page_id", "position", "url", structured.title_of_url(F.col("url")).alias("title"))


@query("raw_json_listing", "SELECT p_partkey, 0 AS position, p_name AS title, '/p/' || p_partkey AS url FROM part UNION ALL SELECT p_partkey, 1, p_brand, '/b/' || p_brand FROM part")
def raw_json_listing(spark, sf_dir) -> DataFrame:
    item = lambda title, url: F.struct(title.alias("title"), url.alias("url"))
    own = item(F.col("p_name"), F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")))
    listed = F.array(own, own, item(F.col("p_brand"), F.concat(F.lit("/b/"), F.col("p_brand"))))
    body = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(listed.alias("items")))).otherwise(F.to_json(F.struct(F.struct(listed.alias("products")).alias("data"))))
    found = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(structured.json_listing(body, "struct<title:string,url:string>")).alias("position", "i"))
    return found.select("p_partkey", "position", "i.title", "i.url")


@query("target_urls_union", "SELECT url, min(rank) AS rank, arg_min(pos, (rank, pos)) AS pos FROM (SELECT trim(url) AS url, 0 AS rank, page_id AS pos FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT trim(url), 1, page_id FROM pages) WHERE regexp_matches(url, '^https?://') GROUP BY url")
def target_urls_union(spark, sf_dir) -> DataFrame:
    """Address lists of two sources, each address once at its first place; an aggregate of structs, no window."""
    rows = table(spark, sf_dir, "pages").select(F.trim("url").alias("url"), F.col("page_id").alias("pos"))
    both = rows.where("pos % 3 = 0").withColumn("rank", F.lit(0)).unionByName(rows.withColumn("rank", F.lit(1)))
    return both.where(F.col("url").rlike("^https?://")).groupBy("url").agg(F.min(F.struct("rank", "pos")).alias("f")).select("url", "f.rank", "f.pos")


@query("selector_read", """SELECT page_id, l[1] AS value, CAST(len(l) AS INTEGER) AS n FROM (SELECT page_id, list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1)[1:12], lambda x: regexp_matches(x, '[0-9]')) AS l FROM pages)""")
def selector_read(spark, sf_dir) -> DataFrame:
    value, n = structured.selector_read(F.col("html"), '<a href="([^"]*)"', "[0-9]")
    return table(spark, sf_dir, "pages").select("page_id", value.alias("value"), n.alias("n"))


_BOX = "SELECT p_brand AS page, p_partkey AS id, (p_partkey % 7) * 150 AS x, (p_partkey % 50) * 60 AS y, 100 AS w, 80 AS h, CASE WHEN p_partkey % 3 = 0 THEN '/' || (p_partkey % 2) END AS href FROM part"


@query("visual_clusters", f"""WITH e AS ({_BOX}) SELECT a.page, a.id, count(*) AS n, min(o.id) AS first FROM e a JOIN e o ON a.page = o.page AND a.href IS NOT NULL AND o.x <= a.x + a.w + 80 AND o.x + o.w >= a.x - 80 AND o.y <= a.y + a.h + 180 AND o.y + o.h >= a.y - 80
 AND CASE WHEN o.href IS NULL THEN o.y + o.h >= a.y ELSE o.href = a.href END GROUP BY a.page, a.id""")
def visual_clusters(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    boxes = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("page"), key.alias("id"), (key % 7 * 150).alias("x"), (key % 50 * 60).alias("y"), F.lit(100).alias("w"), F.lit(80).alias("h"),
        F.when(key % 3 == 0, F.concat(F.lit("/"), (key % 2).cast("string"))).alias("href"),
    )
    return links.box_cluster_sizes(boxes)


@query("variant_matrix", """WITH v AS (SELECT DISTINCT p_brand, p_type, p_size % 5 AS size FROM part), e AS (SELECT p_brand, p_type, p_size % 5 AS size FROM part WHERE p_partkey % 6 = 0)
 SELECT *, EXISTS (SELECT 1 FROM e WHERE e.p_brand = v.p_brand AND e.p_type = v.p_type) AND EXISTS (SELECT 1 FROM e WHERE e.p_brand = v.p_brand AND e.size = v.size) AS matched FROM v""")
def variant_matrix(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", (F.col("p_size") % 5).alias("size"))
    axes = part.where("p_partkey % 6 = 0").groupBy("p_brand").agg(F.collect_set("p_type").alias("p_type"), F.collect_set("size").alias("size"))
    return links.option_matrix(axes, part, "p_brand", ["p_type", "size"])


@query("variant_axes", "SELECT p_brand, string_agg(p_type, '|' ORDER BY first) AS types FROM (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY 1, 2) GROUP BY p_brand")
def variant_axes(spark, sf_dir) -> DataFrame:
    """The distinct values of an axis by first appearance: repeats go before any list is built."""
    first = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "p_type")))
    return first.groupBy("p_brand").agg(F.array_join(F.transform(listed, lambda x: x["p_type"]), "|").alias("types"))


@query("rules_overridden", """WITH s AS (SELECT p_type AS field, p_brand AS selector, p_partkey AS ord FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_type AS field, p_brand AS selector, 1000000000 + p_partkey AS ord FROM part WHERE p_partkey % 40 = 1)
 SELECT field, selector, min(ord) AS ord FROM (SELECT * FROM s WHERE field NOT IN (SELECT field FROM r) UNION ALL SELECT * FROM r) GROUP BY field, selector""")
def rules_overridden(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("field"), F.col("p_brand").alias("selector"), F.col("p_partkey").alias("ord"))
    run = part.where("ord % 40 = 1").withColumn("ord", F.col("ord") + 1_000_000_000)
    return links.overridden(part.where("ord % 2 = 0"), run, "field", ["field", "selector"], "ord")


@query("tables_unnested", """SELECT p_partkey, 1 AS "row", 'name' AS "column", p_name AS value FROM part UNION ALL SELECT p_partkey, 1, 'column_2', p_brand FROM part WHERE p_partkey % 2 = 0
 UNION ALL SELECT p_partkey, 2, 'name', p_type FROM part UNION ALL SELECT p_partkey, 2, 'column_2', 'x' FROM part UNION ALL SELECT p_partkey, 2, 'column_3', 'y' FROM part""")
def tables_unnested(spark, sf_dir) -> DataFrame:
    brand = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" ")
    cells = F.array(F.array(F.col("p_name"), brand), F.array(F.col("p_type"), F.lit("x"), F.lit("y")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.lit("name"), F.lit("")).alias("headers"), cells.alias("cells"))
    return structured.table_cells(rows, "p_partkey", "headers", "cells")


@query("domains_denied", f"""WITH p AS (SELECT page_id, {U['host']} AS host FROM pages), d AS (SELECT DISTINCT {U['registrable']} AS domain FROM pages WHERE page_id % 25 = 0)
 SELECT page_id, host FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE host = domain OR ends_with(host, '.' || domain))""")
def domains_denied(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    denied = pages.where("page_id % 25 = 0").select(urls.registrable_host(F.col("url")).alias("domain"))
    return links.without_domains(pages.select("page_id", urls.host_of(F.col("url")).alias("host")), "page_id", "host", denied)


@query("compare_pairs", """SELECT mode, count(*) AS n FROM (SELECT CASE WHEN k % 11 = 0 THEN 'missing' WHEN k % 10 = 0 THEN 'extra' WHEN k % 7 = 0 AND abs(p - p * 1.3) > 3 THEN 'price_outlier' WHEN k % 13 = 0 THEN 'state_mismatch' ELSE 'same' END AS mode
 FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders) WHERE NOT (k % 10 = 0 AND k % 11 = 0)) GROUP BY mode""")
def compare_pairs(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    other = orders.where("o_orderkey % 11 <> 0").withColumns({
        "o_totalprice": F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") * 1.3).otherwise(F.col("o_totalprice")),
        "o_orderstatus": F.when(F.col("o_orderkey") % 13 == 0, "?").otherwise(F.col("o_orderstatus")),
    })
    return links.compared(orders.where("o_orderkey % 10 <> 0"), other, "o_orderkey", "o_totalprice", "o_orderstatus").groupBy("mode").agg(F.count("*").alias("n"))


@query("values_reduced", """SELECT user_id, string_agg(v, '|' ORDER BY first) AS kinds FROM (SELECT user_id, min(event_id) AS first, arg_min(v, event_id) AS v FROM (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS v FROM events) GROUP BY user_id, lower(v)) GROUP BY user_id""")
def values_reduced(spark, sf_dir) -> DataFrame:
    """Many values of a field to one text: distinct but for case, the first spelling of each, in the order they came."""
    v = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", v.alias("v"))
    first = rows.groupBy("user_id", F.lower("v").alias("low")).agg(F.min("event_id").alias("first"), F.min_by("v", "event_id").alias("v"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "v"))), lambda x: x["v"]), "|").alias("kinds"))


@query("adjacent_distinct", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def adjacent_distinct(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    rows = prefix.running(rows, "user_id", ["event_id"], {"before": (prefix.PREVIOUS, F.col("event_type"))})
    return rows.where(~F.col("before").eqNullSafe(F.col("event_type"))).drop("before")


@query("stale_runs", """SELECT o_orderkey, seen FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 1 DAY END AS seen FROM orders)
 WHERE (o_orderkey % 5 = 0 AND o_orderkey % 2 = 0) OR seen IS NULL OR TIMESTAMP '1996-06-01 00:00:00' - seen >= INTERVAL 120 SECOND""")
def stale_runs(spark, sf_dir) -> DataFrame:
    """A pending run with a task is stale, so is one without any sign of life, and one whose first known sign is 120 s old."""
    key = F.col("o_orderkey")
    heartbeat, updated = F.when(key % 3 == 0, F.col("o_orderdate")), F.when(key % 3 == 1, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(heartbeat, updated).alias("seen"))
    old = F.col("seen") <= F.expr("TIMESTAMP_NTZ '1996-06-01 00:00:00' - INTERVAL 120 SECOND")
    return rows.where(((key % 5 == 0) & (key % 2 == 0)) | F.col("seen").isNull() | old)


@query("barcodes_checked", """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 AND length(d) IN (8, 12, 13, 14) THEN d END AS barcode FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), CAST(6 + p_partkey % 9 AS INTEGER), '0') AS d FROM part)""")
def barcodes_checked(spark, sf_dir) -> DataFrame:
    """Codes with blanks and hyphens count, those with letters don't."""
    key = F.col("p_partkey")
    digits = F.lpad(key.cast("string"), F.lit(6) + (key % 9).cast("int"), F.lit("0"))
    raw = F.when(key % 4 == 0, F.concat(F.lit("EAN-"), digits)).when(key % 4 == 1, F.concat(F.left(digits, F.lit(3)), F.lit(" - "), F.substring(digits, 4, 99))).otherwise(digits)
    return table(spark, sf_dir, "part").select("p_partkey", prices.barcode(raw).alias("barcode"))
