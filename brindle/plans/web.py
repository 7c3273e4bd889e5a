"""Queries over captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import urls
from brindle.plans.registry import query, table
from brindle.sources import pages as scans

U = urls.SQL
_DECODE = "trim(regexp_replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"


def _tag(tag: str) -> str:
    return _DECODE.format(x=f"regexp_replace(regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', '', 'g')")


@query("domain_top", f"SELECT domain, count(*) AS n, min(page_id) AS first_seen FROM (SELECT page_id, CASE WHEN {U['domain']} = '' THEN 'unknown' ELSE {U['domain']} END AS domain FROM pages) GROUP BY domain ORDER BY n DESC, first_seen LIMIT 5")
def domain_top(spark, sf_dir) -> DataFrame:
    """The five domains with most pages; ties by first appearance."""
    named = table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.nullif(urls.normalize_domain(F.col("url")), F.lit("")), F.lit("unknown")).alias("domain"))
    return named.groupBy("domain").agg(F.count("*").alias("n"), F.min("page_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(5)


@query("url_identity", "SELECT page_id, CASE WHEN trim(url) <> '' THEN sha256(trim(url)) END AS identity FROM pages")
def url_identity(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.record_identity(F.col("url")).alias("identity"))


@query("url_canonical", f"SELECT page_id, {U['stripped']} AS stripped, {U['canonical']} AS canonical FROM pages")
def url_canonical(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.strip_tracking(F.col("url")).alias("stripped"), urls.canonical_url(F.col("url")).alias("canonical"))


@query("url_dedupe_first", f"SELECT canonical, min(page_id) AS page_id, count(*) AS copies FROM (SELECT page_id, {U['canonical']} AS canonical FROM pages) GROUP BY canonical")
def url_dedupe_first(spark, sf_dir) -> DataFrame:
    """The first page of each canonical URL; aggregated map-side instead of ranked."""
    named = table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))
    return named.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@query("registrable_site_counts", f"SELECT {U['registrable']} AS site, count(*) AS n, count(DISTINCT {U['host']}) AS hosts FROM pages GROUP BY 1")
def registrable_site_counts(spark, sf_dir) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").groupBy(urls.registrable_host(url).alias("site")).agg(F.count("*").alias("n"), F.count_distinct(urls.host_of(url)).alias("hosts"))


@query("detail_path_flags", f"""SELECT page_id, regexp_matches({U['path']}, '/[0-9]+(\\.html)?/?$') AS detail_like, {U['query']} LIKE '%page=%' AS paginated,
 regexp_matches({U['host']}, '(^|\\.)(example|invalid|test)$|^localhost$') AS special_use,
 starts_with(url, 'http') AND length(url) <= 2048 AND NOT (contains(lower({U['path']}), '/login') OR contains(lower({U['path']}), '/cart') OR contains(lower({U['path']}), '/checkout') OR contains(lower({U['path']}), '/account')) AS safe,
 len(regexp_extract_all(lower(url), 'https?://')) > 1 AS glued FROM pages""")
def detail_path_flags(spark, sf_dir) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.url_path(url).rlike(r"/[0-9]+(\.html)?/?$").alias("detail_like"), F.contains(urls.url_query(url), F.lit("page=")).alias("paginated"),
        urls.is_special_use(urls.host_of(url)).alias("special_use"), urls.navigation_safe(url).alias("safe"), urls.is_concatenated(url).alias("glued"),
    )


@query("page_block_class", "SELECT page_id, CASE WHEN page_id % 50 = 1 THEN 'auth_wall' WHEN page_id % 50 = 2 THEN 'rate_limited' WHEN page_id % 50 = 3 THEN 'challenge' WHEN ("
       + " OR ".join(f"contains(lower(html), '{m}')" for m in scans.BLOCK_MARKS) + ") AND NOT (" + " OR ".join(f"contains(lower(html), '{m}')" for m in scans.CONTENT_MARKS) + ") THEN 'blocked' ELSE 'ok' END AS outcome FROM pages")
def page_block_class(spark, sf_dir) -> DataFrame:
    """Pages carry no status; page_id stands in for one."""
    status = F.when(F.col("page_id") % 50 == 1, 401).when(F.col("page_id") % 50 == 2, 429).when(F.col("page_id") % 50 == 3, 403).otherwise(200)
    return table(spark, sf_dir, "pages").select("page_id", scans.block_class(F.col("html"), status).alias("outcome"))


@query("page_title_h1", f"SELECT page_id, {_tag('title')} AS title, {_tag('h1')} AS h1, {_tag('title')} = '' OR length({_tag('title')}) < 4 OR regexp_matches({_tag('title')}, '(?i)^(home|index|untitled|404|not found|error)$') AS noise FROM pages")
def page_title_h1(spark, sf_dir) -> DataFrame:
    title, h1 = scans.tag_text(F.col("html"), "title"), scans.tag_text(F.col("html"), "h1")
    noise = (title == "") | (F.char_length(title) < 4) | title.rlike("(?i)^(home|index|untitled|404|not found|error)$")
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), h1.alias("h1"), noise.alias("noise"))


@query("page_links_exploded", """SELECT page_id, CAST(i - 1 AS INTEGER) AS position, l[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages), generate_series(1, len(l)) g(i)""")
def page_links_exploded(spark, sf_dir) -> DataFrame:
    return scans.links(table(spark, sf_dir, "pages"))


_CANDIDATES = f"""c AS (
 SELECT page_id, 'title' AS field, 'h1' AS source, 0 AS ord, {_tag('h1')} AS value FROM pages UNION ALL
 SELECT page_id, 'title', 'html_title', 1, {_tag('title')} FROM pages UNION ALL
 SELECT page_id, 'language', 'html_lang', 0, regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1) FROM pages UNION ALL
 SELECT page_id, 'text', 'first_paragraph', 0, {_tag('p')} FROM pages UNION ALL
 SELECT page_id, 'title', 'og', 2, regexp_extract(html, '(?i)<meta\\s+property="og:title"\\s+content="([^"]*)"', 1) FROM pages)"""


@query("page_candidates", f"WITH {_CANDIDATES} SELECT * FROM c WHERE value <> ''")
def page_candidates(spark, sf_dir) -> DataFrame:
    return scans.candidates(table(spark, sf_dir, "pages"))


@query("page_records", f"WITH {_CANDIDATES} SELECT page_id, field, arg_min(source, ord) AS source, arg_min(value, ord) AS value, count(*) AS offers FROM c WHERE value <> '' GROUP BY page_id, field")
def page_records(spark, sf_dir) -> DataFrame:
    """Per page and field the candidate of the first source; one shuffle, combined map-side."""
    return scans.candidates(table(spark, sf_dir, "pages")).groupBy("page_id", "field").agg(F.min_by("source", "ord").alias("source"), F.min_by("value", "ord").alias("value"), F.count("*").alias("offers"))


@query("page_language_share", """SELECT site, lang, n, n / sum(n) OVER (PARTITION BY site) AS share FROM (SELECT """ + U["registrable"] + """ AS site, regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1) AS lang, count(*) AS n FROM pages GROUP BY 1, 2)""")
def page_language_share(spark, sf_dir) -> DataFrame:
    counts = table(spark, sf_dir, "pages").groupBy(urls.registrable_host(F.col("url")).alias("site"), F.regexp_extract("html", '(?i)<html[^>]* lang="([^"]*)"', 1).alias("lang")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("site")))
