"""Lenient numbers, flags and times out of text, as Column expressions. Null where the text says none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import collapsed

# Words for yes and no of remote work.
YES = ["1", "fully remote", "remote", "telecommute", "true", "work from home", "yes"]
NO = ["0", "false", "no", "office", "on site", "onsite"]


def loose_float(value: Column) -> Column:
    """All digits and marks of a text as one number; of two kinds of marks the later is the decimal one, and a last
    comma before one to three digits is decimal too, so 1,234 reads 1.234."""
    kept = F.regexp_replace(value, "[^0-9.,]+", "")
    after_comma, after_dot = F.length(F.substring_index(kept, ",", -1)), F.length(F.substring_index(kept, ".", -1))
    comma, dot = F.contains(kept, F.lit(",")), F.contains(kept, F.lit("."))
    no_commas = F.regexp_replace(kept, ",", "")
    decimal_comma = F.regexp_replace(F.regexp_replace(kept, r"[.](?=.*,)", ""), ",", ".")
    last_comma = F.regexp_replace(F.regexp_replace(kept, ",([^,]*)$", ".$1"), ",", "")
    text = F.when(comma & dot, F.when(after_comma < after_dot, decimal_comma).otherwise(no_commas)).when(comma & after_comma.between(1, 3), last_comma).otherwise(no_commas)
    return F.when(text.rlike(r"^([0-9]+[.]?[0-9]*|[.][0-9]+)$"), text).try_cast("double")


def first_int(value: Column) -> Column:
    """The whole part of the first number, commas taken for grouping marks."""
    found = F.regexp_extract(F.regexp_replace(value, ",", ""), "[-+]?[0-9][0-9.]*", 0)
    return F.when(found.rlike(r"^[-+]?[0-9]+[.]?[0-9]*$"), F.regexp_extract(found, "^([-+]?[0-9]+)", 1)).try_cast("long")


def as_int(value: Column) -> Column:
    """A whole text as an integer, decimals cut off; 0 for anything else and for what 64 bits don't hold."""
    text = F.trim(value)
    number = F.when(text.rlike(r"^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$"), text)
    cut = number.try_cast("double")
    cut = F.when(F.abs(cut) < 9.2e18, cut)
    return F.coalesce(F.when(text.rlike("^[-+]?[0-9]+$"), text).try_cast("long"), F.when(cut < 0, F.ceil(cut)).otherwise(F.floor(cut)).try_cast("long"), F.lit(0).cast("long"))


def yes_or_no(value: Column) -> Column:
    low = F.lower(collapsed(value))
    return F.when(low.isin(YES), True).when(low.isin(NO), False)


def rating(value: Column) -> Column:
    """A plain number to two decimals, ties to even."""
    text = collapsed(value)
    return F.bround(F.when(text.rlike(r"^[-+]?[0-9]+([.][0-9]+)?$"), text).try_cast("decimal(18,6)"), 2).cast("double")


def saved_at(value: Column) -> Column:
    """An ISO 8601 time as UTC without zone; one without a zone is taken as UTC."""
    text = F.trim(value)
    iso = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?(Z|[+-][0-9]{2}:[0-9]{2})?$")
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$") & F.contains(text, F.lit(":"))
    full = F.when(zoned, text).otherwise(F.concat(text, F.when(F.length(text) == 10, F.lit("T00:00:00Z")).otherwise(F.lit("Z"))))
    full = F.regexp_replace(full, "([T ][0-9]{2}:[0-9]{2})(Z|[+-])", "$1:00$2")
    return F.to_utc_timestamp(F.when(iso, full).try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def price_token(value: Column, last: bool = True) -> Column:
    """The last (or first) number beside a currency sign, else one beside a code."""
    signed = F.regexp_extract_all(value, F.lit(r"([$€£¥₹]\s*[0-9][0-9.,]*|[0-9][0-9.,]*\s*[$€£¥₹])"), 1)
    coded = F.regexp_extract_all(F.upper(value), F.lit(r"(\b(?:USD|EUR|GBP|INR|JPY|CAD|AUD)\b\s*[0-9][0-9.,]*|[0-9][0-9.,]*\s*\b(?:USD|EUR|GBP|INR|JPY|CAD|AUD)\b)"), 1)
    found = F.when(F.size(signed) > 0, signed).otherwise(coded)
    return F.when(F.size(found) > 0, F.element_at(found, -1 if last else 1))
