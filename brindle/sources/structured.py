"""Scans of structured data inside documents, as Column expressions: JSON-LD, OpenGraph, sitemaps, JSON listings, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_JSON_LD = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
_OPENGRAPH = r'(?i)<meta\s+property="og:([^"]*)"\s+content="([^"]*)"'
_LOC = r"(?is)<(?:\w+:)?loc[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?loc>"
#: What XML writes for some characters; & comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_NO_TEXTS = "array<string>"
#: Types of nodes that come first, second and last; all others are between.
FIRST, SECOND, LAST = ("Product", "JobPosting", "ItemList"), ("Offer", "AggregateOffer"), ("Brand", "Organization", "Person")
#: Where a JSON document keeps its list of items, by preference.
LISTS = ("$.items", "$.results", "$.products", "$.data.products", "$.data.results")
#: Names of OpenGraph properties as fields.
FIELDS = {"title": "title", "image": "image_url", "price:amount": "price", "price:currency": "currency", "site_name": "site"}


def json_ld_nodes(html: Column) -> Column:
    """array<string>: the JSON objects of all JSON-LD scripts; lists and @graph are flattened, invalid JSON is skipped; null html has none.

    Products, jobs and lists come first, then offers, then others, then brands and people; ties by name, then text.
    """

    def nodes(body: Column) -> Column:
        graph = F.get_json_object(body, "$['@graph']")
        listed = F.when(F.ltrim(body).startswith("["), body).otherwise(graph)
        none = F.array().cast(_NO_TEXTS)
        return F.when(F.try_parse_json(body).isNull(), none).when(listed.isNotNull(), F.from_json(listed, _NO_TEXTS)).otherwise(F.array(body))

    def ordered(node: Column) -> Column:
        kind = F.get_json_object(node, "$['@type']")
        rank = F.when(kind.isin(*FIRST), 0).when(kind.isin(*SECOND), 1).when(kind.isin(*LAST), 3).otherwise(2)
        return F.struct(rank.alias("rank"), F.coalesce(F.get_json_object(node, "$.name"), F.lit("")).alias("name"), node.alias("node"))

    found = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(_JSON_LD), F.lit(1)), nodes))
    return F.coalesce(F.transform(F.array_sort(F.transform(found, ordered)), lambda x: x["node"]), F.array().cast(_NO_TEXTS))


def opengraph(html: Column) -> Column:
    """array<struct<field, value>>: OpenGraph properties under the engine's names, without empty ones; unknown names keep theirs."""
    names = F.create_map(*(F.lit(x) for pair in FIELDS.items() for x in pair))
    keys, values = (F.regexp_extract_all(html, F.lit(_OPENGRAPH), F.lit(i)) for i in (1, 2))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(F.coalesce(F.get(F.array(F.try_element_at(names, k)), 0), k).alias("field"), F.trim(v).alias("value")))
    return F.filter(pairs, lambda p: p["value"] != "")


def sitemap_urls(xml: Column) -> Column:
    """array<string>: the distinct http(s) locations of a sitemap, in their order.

    By pattern, not by ``xpath``: that one cuts a text where the parser's buffer ends.
    """

    def decoded(x: Column) -> Column:
        for entity, char in ENTITIES.items():
            x = F.replace(x, F.lit(entity), F.lit(char))
        return F.trim(x)

    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(xml, F.lit(_LOC), F.lit(1)), decoded), lambda u: u.rlike("^https?://")))


def title_of_url(url: Column) -> Column:
    """A title from a URL's last segment: without extension, dashes and underscores as spaces."""
    last = F.regexp_extract(url, r"/([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[a-z]+$", ""), "[-_]+", " "))


def json_listing(body: Column, item: str) -> Column:
    """array of ``item`` (a struct's DDL): the first known list of a JSON document without repeats; null if there is none."""
    return F.array_distinct(F.from_json(F.coalesce(*(F.get_json_object(body, p) for p in LISTS)), f"array<{item}>"))


def selector_read(text: Column, pattern: str, within: str | None = None, most: int = 12) -> tuple[Column, Column]:
    """The first value a pattern's group reads and how many of the first ``most`` there are; ``within`` filters them."""
    found = F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), 1, most)
    if within:
        found = F.filter(found, lambda x: x.rlike(within))
    return F.get(found, 0), F.size(found)


def table_cells(rows: DataFrame, key: str, headers: str, cells: str) -> DataFrame:
    """(key, row, column, value): ``cells`` (array of arrays) un-nested; rows count from 1, a column without header is column_n, empty cells go."""
    each = rows.select(key, headers, F.posexplode(cells).alias("_row", "_cells")).select(key, headers, "_row", F.posexplode("_cells").alias("_at", "value"))
    name = F.coalesce(F.nullif(F.trim(F.get(F.col(headers), F.col("_at"))), F.lit("")), F.concat(F.lit("column_"), (F.col("_at") + 1).cast("string")))
    return each.select(key, (F.col("_row") + 1).alias("row"), name.alias("column"), "value").where("trim(value) <> ''")
