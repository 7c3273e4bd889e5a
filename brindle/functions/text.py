"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without meaning of their own in keywords.
STOPWORDS = ["and", "for", "from", "the", "with"]
#: Words of a brand, at most.
BRAND_WORDS = 6
# Phrases of titles that lead to a shop's service pages.
UTILITY_TITLES = ["about us", "cart", "checkout", "contact us", "customer service", "gift card", "help", "log in", "login", "my account", "privacy policy", "returns", "shipping", "sign in", "size guide", "store locator", "terms", "wishlist"]


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case runs of a-z and 0-9 of at least ``least`` characters, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def singular(token: Column) -> Column:
    """A lower-case token without the ending of an English plural; short ones and those in -ss stay."""
    n = F.length(token)
    cut = lambda k: F.left(token, n - k)
    return F.when((n > 4) & token.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 4) & token.rlike("(ss|x|ch|sh)es$"), cut(2)).when((n > 3) & token.rlike("(^|[^s])s$"), cut(1)).otherwise(token)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def field_key(name: Column) -> Column:
    """camelCase, spaces and symbols to snake_case; dots stay inside."""
    humps = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    parts = F.filter(F.split(F.lower(humps), "[^a-z0-9.]+"), lambda x: x != "")
    return F.regexp_replace(F.array_join(parts, "_"), "^[._]+|[._]+$", "")


def seo_keywords(text: Column, most: int = 20) -> Column:
    """Words of three letters or more that aren't stop words, then pairs of neighbours; distinct, at most ``most``."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS))
    pairs = F.transform(F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("b")), lambda p: F.concat(p["a"], F.lit(" "), p["b"]))
    return F.slice(F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))), 1, most)


def term_present(text: Column, term: str) -> Column:
    """Whether ``term`` stands in the text with no letter or digit beside it."""
    return F.lower(collapsed(text)).rlike(rf"(^|[^a-z0-9]){re.escape(' '.join(term.lower().split()))}([^a-z0-9]|$)")


def distinct_ignoring_case(values: Column) -> Column:
    """The first of each value but for case, in order."""
    start = F.array().cast("array<string>")
    return F.aggregate(values, start, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def utility_title(title: Column) -> Column:
    """Whether a title is that of a service page."""
    found = F.lit(False)
    for phrase in UTILITY_TITLES:
        found = found | term_present(title, phrase)
    return F.coalesce(found, F.lit(False))


def marked_brand(title: Column) -> Column:
    """What stands before the first trade mark sign, with it, or a sign that begins the title and the word after it, as one; null of more
    than ``BRAND_WORDS`` words or without a sign."""
    text = collapsed(title)
    leading = F.regexp_replace(F.regexp_extract(text, "^[™®] ?[^ ]+", 0), "^(.) ", "$1")
    brand = F.when(text.rlike("^[™®]"), leading).otherwise(F.trim(F.regexp_extract(text, "^[^™®]*[™®]", 0)))
    return F.when((brand != "") & (F.size(tokens(brand, 1)) <= BRAND_WORDS), brand)
