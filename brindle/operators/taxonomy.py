"""Products put under the categories of a taxonomy: exact paths and leaves first, else weighted shares of tokens, by an inverted index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import collapsed, singular
from brindle.operators.matching import exact_category
from brindle.session import spread

# What the second and third pool of a product and a category's attributes weigh beside the first pool, which weighs 1,
# the factor where the first pool meets nothing, and the least score.
SECOND, THIRD, ATTRIBUTES, UNMET, LEAST = 0.35, 0.15, 0.3, 0.6, 0.42
# Fixed values: (terms of a product, texts of paths it can't have).
CONFLICTS = [
    (["apparel", "clothing", "dress", "fashion", "pant", "shirt", "t-shirt", "tee", "trouser"], ["furniture", "shopping bags"]),
    (["boot", "footwear", "oxford", "shoe", "sneaker"], ["undergarments", "underwear"]),
]
#: Rows of the inverted index up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def bag(text: Column) -> Column:
    """The distinct tokens of a text, each in the singular; empty for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")
    return F.array_distinct(F.transform(words, singular))


def _contexts(tokens: Column, conflicts: Sequence[tuple[Sequence[str], Sequence[str]]]) -> Column:
    """array<int>: which of ``conflicts`` a product's tokens bring up, by all tokens of one of its terms."""
    hit = lambda terms: F.exists(F.array(*(bag(F.lit(t)) for t in terms)), lambda t: (F.size(t) > 0) & (F.size(F.array_except(t, tokens)) == 0))
    return F.array_compact(F.array(F.lit(None).cast("int"), *(F.when(hit(terms), n) for n, (terms, _) in enumerate(conflicts) if terms)))


def _barred(path: Column, conflicts: Sequence[tuple[Sequence[str], Sequence[str]]]) -> Column:
    """array<int>: which of ``conflicts`` rule a path out."""
    low = F.lower(collapsed(path))
    return F.array_compact(F.array(F.lit(None).cast("int"), *(F.when(F.exists(F.array(*(F.lit(t.lower()) for t in texts)), lambda t: F.contains(low, t)), n) for n, (_, texts) in enumerate(conflicts) if texts)))


def _share(own: Column, theirs: Column) -> Column:
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, theirs)) / F.size(own))


def ranked_categories(
    products: DataFrame, taxonomy: DataFrame, most: int = 5, conflicts: Sequence[tuple[Sequence[str], Sequence[str]]] = CONFLICTS,
) -> DataFrame:
    """(product_id, category, score, source, rank) of ``products`` (product_id, value, first, second, third), texts all.

    A product whose ``value`` is a path of ``taxonomy`` (category, leaf, attributes), or the leaf of only one, has that category alone:
    ``exact_match``. Others have at most ``most`` (the feature's top-k) by ``scored_match``: the shares of the tokens of each pool
    that are in the path, and of all its tokens in the category's attributes, weighed; 0.42 at least; ties by shorter, then smaller path.
    Categories that contradict the product's words are left out.

    Candidates come from an inverted index of the paths' tokens, and only by tokens that every category with the score must meet one of.
    Where the first pool meets the path, that is any of its tokens; where it doesn't, the second pool must have at least
    (0.42 / 0.6 - 0.15 - 0.3) / 0.35 of its tokens in the path, so all but that many of them, and
    one, are enough: the longest, for long ones are mostly rarer. A pair of product and category comes once,
    from the first such token it shares, so pairs need no shuffle; product rows meet a taxonomy whose size doesn't grow with them.
    Products with the same tokens in each pool have the same categories, so each such kind is asked for once, in several tasks a core.
    Null texts are empty; a product_id that repeats counts as one product with the smallest row of its texts; a null one is left out.
    A category that repeats counts once, with its smallest attributes; a null or blank path is left out.
    """
    texts = ["value", "first", "second", "third"]
    own = products.where("product_id IS NOT NULL").groupBy("product_id").agg(F.min(F.struct(*(F.coalesce(F.col(t).cast("string"), F.lit("")).alias(t) for t in texts))).alias("_t")).select("product_id", "_t.*")
    rows = taxonomy.where(F.trim("category") != "").groupBy("category").agg(F.min(F.coalesce("leaf", F.lit(""))).alias("leaf"), F.min(F.coalesce("attributes", F.lit(""))).alias("attributes"))
    exact = exact_category(own.where(collapsed(F.col("value")) != ""), rows.select("category", "leaf"), "product_id")

    path = bag(F.col("category"))
    index = rows.select("category", path.alias("_path"), F.array_except(bag(F.col("attributes")), path).alias("_more"), _barred(F.col("category"), conflicts).alias("_barred")).withColumn("_token", F.explode("_path"))
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)

    bags = [f"_{t}" for t in texts[1:]]
    meant = own.join(exact.select("product_id"), "product_id", "left_anti").select("product_id", *(F.array_sort(bag(F.col(t))).alias(f"_{t}") for t in texts[1:]))
    meant = spread(meant, "product_id")
    pools = spread(meant.select(*bags).distinct(), *bags)
    pools = pools.withColumn("_all", F.array_union(F.array_union("_first", "_second"), "_third")).withColumn("_contexts", _contexts(F.col("_all"), conflicts))
    need = F.ceil(F.size("_second") * ((LEAST / UNMET - THIRD - ATTRIBUTES) / SECOND) - 1e-9)
    long_first = F.transform(F.array_sort(F.transform("_second", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    asked = pools.withColumn("_asked", F.array_union("_first", F.slice(long_first, F.lit(1), F.size("_second") - need + 1)))
    pairs = asked.withColumn("_token", F.explode("_asked")).join(index, "_token").where(F.get(F.array_intersect("_asked", "_path"), F.lit(0)) == F.col("_token"))
    pairs = pairs.where(~F.arrays_overlap("_contexts", "_barred"))

    first = _share(F.col("_first"), F.col("_path"))
    total = first + _share(F.col("_second"), F.col("_path")) * SECOND + _share(F.col("_third"), F.col("_path")) * THIRD + _share(F.col("_all"), F.col("_more")) * ATTRIBUTES
    scored = pairs.select(*bags, "category", F.when(first == 0, total * UNMET).otherwise(total).alias("score"))
    scored = scored.where(F.col("score") >= LEAST)
    order = Window.partitionBy(*bags).orderBy(F.desc("score"), F.length("category"), "category")
    best = scored.select(*bags, "category", F.round("score", 3).alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    found = best.groupBy(*bags).agg(F.collect_list(F.struct("category", "score", F.lit("scored_match").alias("source"), "rank")).alias("_found"))
    best = meant.join(found.hint("merge"), bags).select("product_id", F.inline("_found"))
    return exact.select("product_id", "category", "score", F.lit("exact_match").alias("source"), F.lit(1).alias("rank")).unionByName(best)
