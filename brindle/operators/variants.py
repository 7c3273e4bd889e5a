"""Variants of products that go because others of their product say more: filters by group, each a few joins on the product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a variant besides its options, words that tell no product, and how long words of titles are at least.
FIELDS = ("availability", "currency", "image_url", "price", "sku", "stock", "title", "url")
STOPWORDS = ["and", "for", "the", "with"]
WORD = 3
#: Words of a colour that reads like another product's name, at least.
COLOUR_WORDS = 5


def cleaned(text: Column) -> Column:
    """A text without blanks around; '' for null."""
    return F.trim(F.coalesce(text.cast("string"), F.lit("")))


def words(text: Column) -> Column:
    """The distinct words of a title that can tell one product from another."""
    return F.array_distinct(F.filter(F.split(F.lower(cleaned(text)), "[^a-z0-9]+"), lambda w: (F.length(w) >= WORD) & ~w.isin(STOPWORDS)))


def options_of(options: Column) -> Column:
    """array<string>: the options with a value as "axis=value", sorted; empty without any."""
    pairs = F.filter(F.map_entries(options), lambda e: cleaned(e["value"]) != "")
    return F.coalesce(F.array_sort(F.transform(pairs, lambda e: F.concat(F.lower(e["key"]), F.lit("="), cleaned(e["value"])))), F.array().cast("array<string>"))


def richness() -> Column:
    """How many fields and options of a variant have a value."""
    return sum((F.when(cleaned(F.col(f)) != "", 1).otherwise(0) for f in FIELDS), F.lit(0)) + F.size(options_of(F.col("options")))


def without_foreign(rows: DataFrame, product_words: Sequence[str] = ()) -> DataFrame:
    """Rows that aren't of another product: one whose title, its options aside, has two words or more and none of the parent's, or
    whose colour is as long as a name, has two words that the parent's title hasn't, and a product's word or a bracket."""
    parent, options = words(F.col("parent_title")), F.flatten(F.transform(F.map_values("options"), words))
    unmatched = F.coalesce(F.array_except(words(F.col("title")), F.coalesce(options, F.array().cast("array<string>"))), F.array().cast("array<string>"))
    other = (F.size(unmatched) >= 2) & ~F.arrays_overlap(unmatched, parent)
    colour = F.coalesce(F.col("options")["color"], F.lit(""))
    strange = F.array_except(words(colour), parent)
    named = F.exists(strange, lambda w: w.isin(*product_words)) if product_words else F.lit(False)
    posing = (F.size(words(colour)) >= COLOUR_WORDS) & (F.size(strange) >= 2) & (named | colour.rlike("[()]"))
    return rows.where((F.size(parent) == 0) | ~(other | posing))


def _told(rows: DataFrame, stats: DataFrame) -> DataFrame:
    return rows.join(stats, F.col("product").eqNullSafe(F.col("_product")), "left")


def without_axisless(rows: DataFrame) -> DataFrame:
    """Rows with an option, and those without where their product has none with one; beside a single kind of options also those with sku or url."""
    own = options_of(F.col("options"))
    stats = rows.where(F.size(own) > 0).groupBy(F.col("product").alias("_product")).agg(F.count_distinct(own).alias("_kinds"))
    stays = (F.size(own) > 0) | F.col("_kinds").isNull() | ((F.col("_kinds") < 2) & ((cleaned(F.col("sku")) != "") | (cleaned(F.col("url")) != "")))
    return _told(rows, stats).where(stays).select(*rows.columns)


def without_colour_only(rows: DataFrame) -> DataFrame:
    """Rows but those with a colour and no size, where two rows or more have a size, none has both, and all such colours are the parent's."""
    size, colour = cleaned(F.col("options")["size"]) != "", cleaned(F.col("options")["color"]) != ""
    alike = (F.lower(cleaned(F.col("options")["color"])) == F.lower(cleaned(F.col("parent_color")))) & (cleaned(F.col("parent_color")) != "")
    stats = rows.groupBy(F.col("product").alias("_product")).agg(
        F.count_if(size).alias("_sized"), F.count_if(size & colour).alias("_both"), F.count_if(colour & ~size & ~alike).alias("_unlike")
    )
    gone = colour & ~size & (F.col("_both") == 0) & (F.col("_sized") >= 2) & (F.col("_unlike") == 0)
    return _told(rows, stats).where(~F.coalesce(gone, F.lit(False))).select(*rows.columns)


def without_dominated(rows: DataFrame) -> DataFrame:
    """Rows whose options aren't a proper part of another row's of their product.

    Rows of equal options are one set. A set is looked up in an inverted index of its product's sets by the option that
    fewest of them have, so what it meets are the sets that share its rarest option, not all. Rows without options stay.
    """
    own = options_of(F.col("options"))
    sets = rows.select("product", own.alias("set")).where("product IS NOT NULL AND size(set) > 0").distinct()
    postings = sets.select("product", "set", F.explode("set").alias("option"))
    counts = postings.groupBy("product", "option").agg(F.count("*").alias("n"))
    asking = postings.join(counts, ["product", "option"]).groupBy("product", "set").agg(F.min(F.struct("n", "option"))["option"].alias("option"))
    met = asking.join(postings.withColumnRenamed("set", "richer"), ["product", "option"])
    gone = met.where((F.size("richer") > F.size("set")) & (F.size(F.array_except("set", "richer")) == 0)).select("product", F.col("set").alias("_set")).distinct()
    return rows.withColumn("_set", own).join(gone, ["product", "_set"], "left_anti").select(*rows.columns)


def without_parent_skus(rows: DataFrame) -> DataFrame:
    """Rows but those whose sku another row of the product goes on, behind a mark, to end in the size of this one, if that row says as much."""
    token = lambda text: F.regexp_replace(F.lower(cleaned(text)), "[^a-z0-9]+", "")
    sku, size = F.lower(cleaned(F.col("sku"))), token(F.col("options")["size"])
    end = F.try_element_at(F.filter(F.split(sku, "[^a-z0-9]+"), lambda t: t != ""), F.lit(-1))
    children = rows.where((sku != "") & end.isNotNull()).select("product", end.alias("_size"), F.col("variant").alias("_child"), sku.alias("_sku"), richness().alias("_rich"))
    parents = rows.where((sku != "") & (size != "")).select("product", size.alias("_size"), "variant", sku.alias("_own"), richness().alias("_owns"))
    mark = F.substring(F.col("_sku"), F.length("_own") + 1, F.lit(1))
    longer = F.col("_sku").startswith(F.col("_own")) & (F.length("_sku") > F.length("_own")) & ~mark.rlike("[a-z0-9]")
    gone = parents.join(children, ["product", "_size"]).where(longer & (F.col("variant") != F.col("_child")) & (F.col("_rich") >= F.col("_owns"))).select("product", "variant").distinct()
    return rows.join(gone, ["product", "variant"], "left_anti").select(*rows.columns)


def without_bare_numbers(rows: DataFrame) -> DataFrame:
    """Rows but those of products all of whose variants have a number for a size and nothing that the parent hasn't: they say nothing."""
    blank = lambda *names: F.forall(F.array(*(cleaned(F.col(n)) for n in names)), lambda x: x == "")
    bare = blank("sku", "url", "image_url", "availability", "stock") & (cleaned(F.col("options")["color"]) == "") & cleaned(F.col("options")["size"]).rlike("^[0-9]+$")
    same = lambda own, parent: (cleaned(F.col(own)) == "") | (cleaned(F.col(own)) == cleaned(F.col(parent)))
    nothing = F.coalesce(bare, F.lit(False)) & same("price", "parent_price") & same("currency", "parent_currency")
    stats = rows.groupBy(F.col("product").alias("_product")).agg(F.bool_and(nothing).alias("_nothing"))
    return _told(rows, stats).where(~F.col("_nothing")).select(*rows.columns)


def pruned(rows: DataFrame, product_words: Sequence[str] = ()) -> DataFrame:
    """Variants (product, variant, ``FIELDS``, options map, parent_title, parent_color, parent_price, parent_currency) that all filters keep.

    The order: rows of other products, rows without options, colours alone, parts of richer rows, parents' skus, bare numbers.
    Variants are told by (product, variant); rows without a product are compared with each other by the filters that count,
    and left alone by those that pair rows. A product can lose all its variants to the first and the last filter only.
    """
    rows = without_colour_only(without_axisless(without_foreign(rows, product_words)))
    return without_bare_numbers(without_parent_skus(without_dominated(rows)))
