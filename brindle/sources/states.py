"""JSON that pages carry in scripts: scripts of JSON, assignments whose value ends where its brackets balance, and hydrated state."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brindle.functions.once import once

# Types of scripts that are JSON, ids of scripts that hold a page's state, names states are assigned to, and names of other data.
JSON_TYPES = ("application/hal+json", "application/json", "application/vnd.api+json")
STATE_IDS = ("__NEXT_DATA__", "__NUXT_DATA__")
STATE_NAMES = ("__APOLLO_STATE__", "__INITIAL_STATE__", "__NEXT_DATA__", "__NUXT__", "__PRELOADED_STATE__", "__STATE__")
DATA_NAMES = ("data", "initialData", "pageData", "product", "productData", "productJson")
#: Kinds of a flattened state's wrappers that stand for what they wrap.
WRAPPERS = ("NuxtError", "Reactive", "Ref", "ShallowReactive", "ShallowRef")

_SCRIPT = r"(?is)<script([^>]*)>(.*?)</script\s*>"
_TOKEN = r"""(?s)\\.|["{}\[\]]|[^"\\{}\[\]]+|\\"""
_PUSH = r'self\.__next_f\.push\(\[\s*\d+\s*,\s*"((?:[^"\\]|\\.)*+)"\s*\]\)'


def balanced(text: Column) -> Column:
    """The text from its first { or [ to where that kind of bracket is balanced; brackets in strings don't count. Null if it never is.

    A fold over tokens (escapes, quotes, brackets, all between) that keeps the depth, whether a string is open, and the length.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def ended(kind: Column) -> Column:
        body, opening, closing = kind["body"], kind["opening"], kind["closing"]

        def step(acc: Column, token: Column) -> Column:
            last = F.substring(token, -1, 1)  # outside of strings an escape says nothing, so what it stands before counts
            escape = F.substring(token, 1, 1) == "\\"
            depth = acc["depth"] + F.when(acc["inside"], 0).when(last == opening, 1).when(last == closing, -1).otherwise(0)
            quote = (last == '"') & ~(acc["inside"] & escape)
            after = F.struct(depth.alias("depth"), (acc["inside"] != quote).alias("inside"), (acc["length"] + F.length(token)).alias("length"), ((depth == 0) & ~acc["inside"] & (last == closing)).alias("done"))
            return F.when(acc["done"], acc).otherwise(after)

        return F.aggregate(F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0)), start, step, lambda acc: F.when(acc["done"], F.substring(body, F.lit(1), acc["length"])))

    # the text and its brackets are worked out once, not for each of its tokens
    opened = once(F.regexp_extract(text, r"(?s)[\[{].*", 0), lambda body: F.struct(body.alias("body"), F.substring(body, 1, 1).alias("opening"), F.when(F.substring(body, 1, 1) == "{", "}").otherwise("]").alias("closing")))
    return once(opened, ended)


def scripts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, script, type, id, body) of the scripts of each document, from 0; type and id in lower case and as they stand, '' if there are none."""
    found = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(_SCRIPT), F.lit(1)).alias("a"), F.regexp_extract_all(F.col(html), F.lit(_SCRIPT), F.lit(2)).alias("body"))
    attribute = lambda name: F.trim(F.regexp_replace(F.regexp_extract("a", rf"""(?i)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), "^[\"']|[\"']$", ""))
    each = pages.select(key, F.posexplode(found).alias("script", "s")).select(key, "script", "s.a", "s.body")
    return each.select(key, "script", F.lower(attribute("type")).alias("type"), attribute("id").alias("id"), "body")


def assignments(found: DataFrame, pattern: str, key: str = "page_id") -> DataFrame:
    """(key, script, nth, name, body) of what the scripts assign where ``pattern`` ends; its only group is the name. body is valid JSON."""
    length = lambda texts: F.aggregate(texts, F.lit(0), lambda acc, x: acc + F.length(x))
    cut = F.struct(*(c.alias(n) for n, c in (("parts", F.split("body", pattern)), ("marks", F.regexp_extract_all("body", F.lit(pattern), F.lit(0))), ("names", F.regexp_extract_all("body", F.lit(pattern), F.lit(1))))))

    def values(c: Column) -> Column:
        at = lambda i: length(F.slice(c["parts"], F.lit(1), i + 1)) + length(F.slice(c["marks"], F.lit(1), i + 1))
        valid = lambda i: once(balanced(F.substring(F.col("body"), at(i) + 1, F.length("body"))), lambda x: F.when(F.try_parse_json(x).isNotNull(), x))
        return F.transform(c["names"], lambda name, i: F.struct(name.alias("name"), valid(i).alias("value")))

    marked = found.where(F.col("body").rlike(pattern))
    each = marked.select(key, "script", F.posexplode(once(cut, values)).alias("nth", "m"))
    return each.where("m.value IS NOT NULL").select(key, "script", "nth", "m.name", F.col("m.value").alias("body"))


def _names(names: tuple[str, ...]) -> str:
    return "(" + "|".join(re.escape(n) for n in names) + ")"


def embedded_json(pages: DataFrame, key: str = "page_id", html: str = "html", names: tuple[str, ...] = DATA_NAMES) -> DataFrame:
    """(key, script, nth, source, body) of JSON in each document: whole scripts of a JSON type, and variables declared by one of ``names``.

    Scripts that hold a page's state are ``page_states``'. Invalid JSON is skipped; nth counts a script's assignments from 0.
    """
    found = scripts(pages, key, html)
    typed = found.where(F.col("type").isin(*JSON_TYPES) & ~F.col("id").isin(*STATE_IDS) & F.try_parse_json("body").isNotNull())
    declared = assignments(found, rf"(?:var|let|const)\s+{_names(names)}\s*=\s*", key)
    return typed.select(key, "script", F.lit(0).alias("nth"), F.lit("script").alias("source"), F.trim("body").alias("body")).unionByName(
        declared.select(key, "script", "nth", F.col("name").alias("source"), "body")
    )


def revived(slots: list) -> object:
    """What a flattened state stands for: slot 0, with numbers as references to slots. A reference to none, or to a value around it, is null."""

    def value(x: object, around: frozenset[int]) -> object:
        return slot(x, around) if isinstance(x, int) and not isinstance(x, bool) else x

    def slot(i: int, around: frozenset[int]) -> object:
        if not 0 <= i < len(slots) or i in around:
            return None
        own, around = slots[i], around | {i}
        if isinstance(own, dict):
            return {k: value(x, around) for k, x in own.items()}
        if isinstance(own, list):
            if len(own) == 2 and own[0] in WRAPPERS:
                return value(own[1], around)
            return [value(x, around) for x in own]
        return own

    return slot(0, frozenset())


@F.pandas_udf(StringType())
def _revived(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(body: str | None) -> str | None:
        try:
            slots = json.loads(body or "")
            return json.dumps(revived(slots) if isinstance(slots, list) and slots else slots, ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    for batch in bodies:
        yield batch.map(one)


def page_states(pages: DataFrame, key: str = "page_id", html: str = "html", names: tuple[str, ...] = STATE_NAMES) -> DataFrame:
    """(key, name, body) of the state each document is hydrated from, one row a name.

    A name's state is what is assigned to it, on window, self or globalThis first, then declared, then bare, and of those the first
    in the document; or else the script with that id. A flattened state is revived. The pieces that
    are pushed one by one have a list of their own, ``__NEXT_F__``. Invalid JSON and never balanced brackets are no state.
    """
    found = scripts(pages, key, html)
    name = _names(names)
    ways = [rf"(?:window|self|globalThis)\s*(?:\.\s*|\[\s*['\"]){name}(?:['\"]\s*\])?\s*=\s*", rf"(?:var|let|const)\s+{name}\s*=\s*", rf"(?m)(?:^|[;,])\s*{name}\s*=\s*"]
    given = found.where(F.col("id").isin(*STATE_IDS) & F.try_parse_json("body").isNotNull())
    nuxt = given.where("id = '__NUXT_DATA__'").withColumn("body", _revived("body"))
    offers = [given.where("id <> '__NUXT_DATA__'").unionByName(nuxt).select(key, F.col("id").alias("name"), F.lit(len(ways)).alias("way"), "script", F.lit(0).alias("nth"), F.trim("body").alias("body"))]
    offers += [assignments(found, way, key).select(key, "name", F.lit(i).alias("way"), "script", "nth", "body") for i, way in enumerate(ways)]
    every = offers[0]
    for more in offers[1:]:
        every = every.unionByName(more)
    states = every.groupBy(key, "name").agg(F.min_by("body", F.struct("way", "script", "nth")).alias("body"))
    pushed = found.select(key, "script", F.posexplode(F.regexp_extract_all("body", F.lit(_PUSH), F.lit(1))).alias("nth", "raw"))
    text = F.from_json(F.concat(F.lit('{"t":"'), "raw", F.lit('"}')), "t string")["t"]
    piece = pushed.select(key, "script", "nth", F.trim(F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1)).alias("piece")).where(F.col("piece").rlike(r"^[\[{]") & F.try_parse_json("piece").isNotNull())
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("script", "nth", "piece"))), lambda p: p["piece"])
    return states.unionByName(piece.groupBy(key).agg(F.concat(F.lit("["), F.array_join(pieces, ","), F.lit("]")).alias("body")).select(key, F.lit("__NEXT_F__").alias("name"), "body"))
