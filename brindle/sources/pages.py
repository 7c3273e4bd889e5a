"""Scans of captured pages: titles, links, blocks, structured data, sitemaps and raw JSON, as rows of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks of pages that block a visitor, and of what a page offers nonetheless.
BLOCK_MARKS = ["access denied", "are you a robot", "captcha", "cf-challenge", "verify you are human"]
CONTENT_MARKS = ["<article", "<main", "application/ld+json"]


def decoded(text: Column) -> Column:
    """The five named entities of XML, numeric blanks and runs of white space resolved."""
    out = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tag_text(html: Column, tag: str) -> Column:
    """The text of the first such element, tags within removed; '' if there is none."""
    return decoded(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href) of each <a href>, positions from 0. Pages without links give no rows."""
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(hrefs).alias("position", "href"))


def block_class(html: Column, status: Column) -> Column:
    """auth_wall, rate_limited, challenge, blocked or ok: the status decides first, then marks, unless there is content."""
    low = F.lower(html)
    marked = F.exists(F.array(*map(F.lit, BLOCK_MARKS)), lambda m: F.contains(low, m))
    content = F.exists(F.array(*map(F.lit, CONTENT_MARKS)), lambda m: F.contains(low, m))
    return F.when(status == 401, "auth_wall").when(status == 429, "rate_limited").when(status == 403, "challenge").when(marked & ~content, "blocked").otherwise("ok")


def candidates(pages: DataFrame) -> DataFrame:
    """(page_id, field, source, ord, value): what each page offers for a field, before arbitration. Blank values are left out."""
    offers = [
        ("title", "h1", 0, tag_text(F.col("html"), "h1")),
        ("title", "html_title", 1, tag_text(F.col("html"), "title")),
        ("language", "html_lang", 0, F.regexp_extract("html", '(?i)<html[^>]* lang="([^"]*)"', 1)),
        ("text", "first_paragraph", 0, tag_text(F.col("html"), "p")),
        ("title", "og", 2, F.regexp_extract("html", r'(?i)<meta\s+property="og:title"\s+content="([^"]*)"', 1)),
    ]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(s).alias("source"), F.lit(o).alias("ord"), v.alias("value")) for f, s, o, v in offers)))
    return pages.select("page_id", each.alias("c")).select("page_id", "c.*").where("value <> ''")


def json_ld(pages: DataFrame) -> DataFrame:
    """(page_id, script, node, body): the objects of all JSON-LD scripts, @graph and lists flattened; invalid JSON is skipped.

    ``body`` is the object as JSON text; numbers from 0.
    """
    scripts = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)
    each = pages.select("page_id", F.posexplode(scripts).alias("script", "raw")).withColumn("v", F.try_parse_json("raw")).where("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    graph, array = F.try_variant_get("v", "$['@graph']", "array<variant>"), F.try_variant_get("v", "$", "array<variant>")
    listed = each.select("page_id", "script", F.coalesce(graph, F.when(kind.startswith("ARRAY"), array), F.array("v")).alias("nodes"))
    return listed.select("page_id", "script", F.posexplode("nodes").alias("node", "v")).select("page_id", "script", "node", F.to_json("v").alias("body"))


def open_graph(pages: DataFrame) -> DataFrame:
    """(page_id, properties map<string,string>) of og: metas; of a repeated property the last one counts."""
    metas = F.regexp_extract_all("html", F.lit(r'(?i)<meta\s+property="og:[^"]*"\s+content="[^"]*"'), 0)
    pair = lambda m: F.struct(F.regexp_extract(m, r'(?i)og:([^"]*)"', 1).alias("k"), decoded(F.regexp_extract(m, r'(?i)content="([^"]*)"', 1)).alias("v"))
    last = F.aggregate(F.transform(metas, pair), F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    return pages.select("page_id", last.alias("properties"))


def sitemap(documents: DataFrame, limit: int = 1000) -> DataFrame:
    """(page_id, url, title) of the distinct <loc> entries of sitemaps (page_id, xml), at most ``limit`` a document (the feature's limit).

    The title is the last part of the path with dashes as spaces.
    """
    locs = F.array_distinct(F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1), decoded))
    each = documents.select("page_id", F.explode(F.slice(locs, 1, limit)).alias("url"))
    return each.withColumn("title", F.regexp_replace(F.regexp_extract("url", r"([^/?#]*)/?(?:[?#].*)?$", 1), "[-_]+", " "))


def raw_json(documents: DataFrame, keys: tuple[str, ...] = ("products", "items", "results", "jobs", "data")) -> DataFrame:
    """(page_id, position, body) of JSON bodies (page_id, text): an array's items, those below the first known key, or the object itself."""
    v = documents.withColumn("v", F.try_parse_json("text")).where("v IS NOT NULL")
    known = [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in keys]
    rows = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *known, F.array("v"))
    return v.select("page_id", F.posexplode(rows).alias("position", "item")).select("page_id", "position", F.to_json("item").alias("body"))


def csv_urls(lines: DataFrame) -> DataFrame:
    """(line, url) of the first column of CSV lines (line, text) where it is an http(s) URL; headers fall out by themselves."""
    first = F.trim(F.regexp_replace(F.substring_index("text", ",", 1), '^"|"$', ""))
    return lines.select("line", first.alias("url")).where(F.col("url").rlike("(?i)^https?://"))


#: Rows of a tables trace, as exports keep it.
TABLES = T.ArrayType(T.StructType([T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))]))


def table_rows(records: DataFrame) -> DataFrame:
    """(record_id, table_index, row_index, column, value) of records with a ``tables`` trace; a missing header is column_N; blanks drop."""
    tables = records.select("record_id", F.posexplode("tables").alias("table_index", "t"))
    rows = tables.select("record_id", "table_index", F.col("t.headers").alias("headers"), F.posexplode("t.rows").alias("row", "cells"))
    cells = rows.select("record_id", "table_index", (F.col("row") + 1).alias("row_index"), "headers", F.posexplode("cells").alias("c", "value"))
    header = F.coalesce(F.nullif(F.try_element_at("headers", F.col("c") + 1), F.lit("")), F.concat(F.lit("column_"), F.col("c") + 1))
    return cells.where("coalesce(value, '') <> ''").select("record_id", "table_index", "row_index", header.alias("column"), "value")
