"""Record matching and lookups: scored pairs within blocks, token-index joins, fills from side tables."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brindle.functions.text import jaccard, tokens
from brindle.session import spread

# Weights of a match.
TITLE, BRAND, IDENTIFIER, BAND, MOST_AUTHORITY = 0.34, 0.24, 0.25, 0.05, 0.12
#: Slices of the candidates and of the sources of a key; each meets each, so a key has as many parts as their product.
CANDIDATE_SLICES, SOURCE_SLICES = 16, 4
#: Pairs of texts a Python worker remembers the ratio of.
REMEMBERED = 1 << 16


def within_band(price: Column, other: Column, band: float = 0.25) -> Column:
    """Whether ``other`` is within a share ``band`` of ``price``; both must be positive."""
    return F.coalesce((price > 0) & (other > 0) & (F.abs(price - other) / price <= band), F.lit(False))


def match_score(title: Column, same_brand: Column, same_identifier: Column, in_band: Column, authority: Column) -> Column:
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    total = TITLE * title + BRAND * number(same_brand) + IDENTIFIER * number(same_identifier) + BAND * number(in_band) + F.least(authority, F.lit(MOST_AUTHORITY))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def match_label(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("uncertain")


@lru_cache(REMEMBERED)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two texts in matching blocks, on Arrow batches; no built-in function has it."""
    return pd.Series([_ratio(x, y) if x and y else 0.0 for x, y in zip(a, b)])


def scored_pairs(source: DataFrame, candidates: DataFrame, key: str, sequence: bool = False) -> DataFrame:
    """Scores each candidate of a source, joined on ``key``: (key, source id, candidate id, score, label).

    ``source`` has (key, s_id, s_title, s_brand, s_sku, s_price) and perhaps s_gtin and s_mpn, ``candidates`` the same with c_ and c_authority.
    Titles are cut to tokens once a row, before the join, not once a pair. With ``sequence``, titles are as similar
    as the better of their shared tokens and the matching blocks of their sorted tokens says.

    Each side of a key is cut into slices by its ids, and every slice of one meets every slice of the other in a task of its own
    hash, so a key's pairs are spread. Within a slice rows with the same tokens meet as one row and are laid out to pairs
    only once their titles are compared; no pair is shuffled.
    """
    names = [c for c in ("gtin", "mpn", "sku") if f"s_{c}" in source.columns and f"c_{c}" in candidates.columns]
    plain = lambda c: F.nullif(F.lower(F.trim(c)), F.lit("")).alias(c)

    def sliced(rows: DataFrame, side: str, own: int, other: int, more: list[str]) -> DataFrame:
        kept = F.struct(f"{side}_id", f"{side}_price", *(plain(f"{side}_{c}") for c in ("brand", *names)), *more)
        tokens_ = F.array_sort(F.array_distinct(tokens(F.col(f"{side}_title")))).alias(f"_{side}_tokens")
        alike = rows.where(F.col(key).isNotNull()).groupBy(key, F.pmod(F.xxhash64(f"{side}_id"), F.lit(own)).cast("int").alias(f"_{side}_slice"), tokens_).agg(F.collect_list(kept).alias(f"_{side}"))
        parts = alike.withColumn(f"_{'c' if side == 's' else 's'}_slice", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        return spread(parts, key, "_s_slice", "_c_slice")

    met = sliced(source, "s", SOURCE_SLICES, CANDIDATE_SLICES, []).hint("merge").join(sliced(candidates, "c", CANDIDATE_SLICES, SOURCE_SLICES, ["c_authority"]), [key, "_s_slice", "_c_slice"])
    title = jaccard(F.col("_s_tokens"), F.col("_c_tokens"))
    if sequence:
        title = F.greatest(title, sequence_ratio(F.array_join("_s_tokens", " "), F.array_join("_c_tokens", " ")))
    pairs = met.select(key, title.alias("_title"), "_s", "_c").select(key, "_title", "_c", F.inline("_s")).select("*", F.inline("_c"))
    same = lambda c: F.coalesce(F.col(f"s_{c}") == F.col(f"c_{c}"), F.lit(False))
    identifier = F.lit(False)
    for c in names:
        identifier = identifier | same(c)
    score = match_score(F.col("_title"), same("brand"), identifier, within_band(F.col("s_price"), F.col("c_price")), F.col("c_authority"))
    return pairs.select(key, "s_id", "c_id", score.alias("score")).withColumn("label", match_label(F.col("score")))


def taxonomy_match(products: DataFrame, taxonomy: DataFrame, least: float = 0.42, most: int = 5) -> DataFrame:
    """(product_id, category, score, rank): the best categories of a product by share of category tokens found in its text.

    Products with the same tokens have the same categories, so each set of tokens is asked for once. An inverted-index equi-join on
    tokens, in place of a nested loop; a pair of set and category comes once, from the first token they share, so pairs aren't
    summed by a shuffle. At most ``most`` categories a product (the feature's top-k), ties by shorter, then smaller path.
    """
    bag = lambda text: F.array_sort(F.array_distinct(tokens(F.col(text))))
    own = spread(products.select("product_id", bag("text").alias("_bag")), "product_id")
    asked = spread(own.select("_bag").distinct(), "_bag").withColumn("_token", F.explode("_bag"))
    index = taxonomy.select("category", bag("category").alias("_own")).withColumn("_token", F.explode("_own"))
    both = F.array_intersect("_bag", "_own")
    pairs = asked.join(index, "_token").select("_bag", "category", "_token", both.alias("_both"), F.size("_own").alias("_n")).where(F.get("_both", F.lit(0)) == F.col("_token"))
    hits = pairs.select("_bag", "category", (F.size("_both") / F.col("_n")).alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy("_bag").orderBy(F.desc("score"), F.length("category"), "category")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    found = best.groupBy("_bag").agg(F.collect_list(F.struct("category", "score", "rank")).alias("_found"))
    return own.join(found.hint("merge"), "_bag").select("product_id", F.inline("_found"))


def filled(rows: DataFrame, by_id: DataFrame, by_title: DataFrame, id_column: str, title_column: str, fields: list[str]) -> DataFrame:
    """Fills null ``fields`` of rows from ``by_id``, else from ``by_title`` (lower case); later rows (``ord``) of a side table win."""
    out = rows
    for side, on, name in ((by_id, F.col(id_column), "i"), (by_title, F.lower(F.col(title_column)), "t")):
        last = side.groupBy(F.col("key").alias(f"_{name}")).agg(*(F.max_by(f, "ord").alias(f"_{name}_{f}") for f in fields))
        out = out.join(last, on == F.col(f"_{name}"), "left").drop(f"_{name}")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f, f"_i_{f}", f"_t_{f}")).drop(f"_i_{f}", f"_t_{f}")
    return out


def brand_key(brand: Column, aliases: dict[str, str]) -> Column:
    """A brand's letters and digits in lower case, under its main name."""
    key = F.trim(F.regexp_replace(F.lower(brand), "[^a-z0-9]+", " "))
    for alias, name in aliases.items():
        key = F.when(key == alias, name).otherwise(key)
    return key


def search_queries(brand: Column, title: Column, identifier: Column, brand_domain: Column, source_domain: Column) -> Column:
    """At most five search texts of a product, the most telling first; the source's own site is left out of each."""
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    out = F.when(some(source_domain), F.concat(F.lit("-site:"), source_domain))
    ways = [
        (some(brand) & some(title) & some(brand_domain), [quoted(brand), quoted(title), F.concat(F.lit("site:"), brand_domain)]), (some(brand) & some(title) & some(identifier), [quoted(brand), quoted(title), quoted(identifier)]),
        (some(brand) & some(title), [quoted(brand), quoted(title), F.lit("buy")]), (some(title) & some(identifier), [quoted(title), quoted(identifier)]), (some(title), [quoted(title), F.lit("buy")]),
    ]
    return F.array_distinct(F.array_compact(F.array(*(F.when(when, F.concat_ws(" ", *parts, out)) for when, parts in ways))))


def exact_category(products: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """(key, category, score) of products (key, value): the category (category, leaf) whose path is the value, scored 1, else the only one
    whose leaf it is, scored 0.92. Two equi-joins; case and blanks don't count."""
    from brindle.functions.text import collapsed

    own = products.select(key, collapsed(F.lower("value")).alias("_value"))
    paths = taxonomy.groupBy(collapsed(F.lower("category")).alias("_value")).agg(F.min("category").alias("_path"))
    leaves = taxonomy.groupBy(collapsed(F.lower("leaf")).alias("_value")).agg(F.min("category").alias("_leaf"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    found = own.join(paths, "_value", "left").join(leaves, "_value", "left").where("_path IS NOT NULL OR _leaf IS NOT NULL")
    return found.select(key, F.coalesce("_path", "_leaf").alias("category"), F.when(F.col("_path").isNotNull(), 1.0).otherwise(0.92).alias("score"))
