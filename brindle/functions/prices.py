"""Prices, amounts and availability as Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases by state, tried from the longest on; whole values of schema.org and the like; currency signs and codes; words beside prices.
AVAILABILITY = {
    "in_stock": ["in stock", "instock", "available", "ready to ship"],
    "limited_stock": ["limited stock", "limitedstock", "low stock", "lowstock", "only", "left in stock"],
    "out_of_stock": ["out of stock", "outofstock", "oos", "sold out", "unavailable"],
    "preorder": ["pre-order", "preorder", "backorder", "back-order"],
}
AVAILABILITY_NAMES = {"instock": "in_stock", "outofstock": "out_of_stock", "limitedavailability": "limited_stock", "preorder": "pre_order"}
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
CODES = ["AED", "AUD", "BRL", "CAD", "CHF", "CNY", "DKK", "EUR", "GBP", "HKD", "INR", "JPY", "KRW", "MXN", "NOK", "NZD", "PLN", "SEK", "SGD", "USD", "ZAR"]
BESIDE_PRICES = ["cost", "from", "mrp", "msrp", "now", "price", "sale", "starting", "starting at"]

_CODE = "|".join(CODES)
_MONEY = rf"(?i)[$€£¥₹]|\b(?:{'|'.join(BESIDE_PRICES)}|{_CODE}|rs\.?)\b"
_CURRENCY = rf"(?i)^(?:[{''.join(SIGNS)}]|rs\.?|{_CODE})\s*"
# Words that mark the stock code of a draft.
DRAFTS = ["copy", "draft", "temp", "test", "tmp"]


def canonical_number(number: Column) -> Column:
    """An unsigned number with marks in plain notation, or null if its marks can't be told apart.

    Its marks part it into groups; the question is which mark, if any, stands before the fraction. Of two kinds it is the kind of
    the last one, which must be alone of its kind. Commas only: the last, before a group of one or two. Dots only: none if all groups
    behind dots have three digits, else the dot, which must be the only one.
    """
    groups, marks = F.split(number, "[.,]"), F.regexp_replace(number, "[^.,]", "")
    last, tail = F.right(marks, F.lit(1)), F.element_at(groups, -1)
    both = F.contains(marks, F.lit(",")) & F.contains(marks, F.lit("."))
    thousands = F.forall(F.slice(groups, F.lit(2), F.size(groups)), lambda g: F.length(g) == 3)
    whole = (marks == "") | (~both & F.when(last == ",", ~F.length(tail).between(1, 2)).otherwise(thousands))
    alone = (last == ",") & ~both | (F.length(F.replace(marks, last)) == F.length(marks) - 1)
    head = F.array_join(F.slice(groups, F.lit(1), F.size(groups) - 1), "")
    return F.when(whole, F.array_join(groups, "")).when(alone, F.concat(head, F.lit("."), tail))


def _negative(text: Column) -> Column:
    """Whether a text begins with a minus sign and then, a currency aside, a digit."""
    behind = F.ltrim(F.substring(text, F.lit(2), F.length(text)))
    return text.startswith("-") & F.regexp_replace(behind, _CURRENCY, "").rlike("^[0-9]")


def decimal_price(value: Column) -> Column:
    """A price text as a plain decimal text. Null if it is blank, negative or no number, or a whole number of up to three
    digits without any sign of money."""
    text = F.trim(F.regexp_replace(value, r"\s+", " "))
    met = F.regexp_extract(text, r"[-+]?[0-9][0-9.,]*", 0)
    number = F.regexp_replace(canonical_number(F.regexp_replace(met, r"^[-+]|[.,]+$", "")), "^0+(?=[0-9])", "")
    small = ~F.contains(number, F.lit(".")) & (F.length(number) <= 3)
    money = text.rlike(_MONEY)
    return F.when(number.rlike(r"^[0-9]+(\.[0-9]+)?$") & ~met.startswith("-") & ~_negative(text) & (~small | money), number)


def currency_of(value: Column) -> Column:
    """The code of the first currency sign met, else an ISO code written out, else null."""
    out = F.upper(F.regexp_extract(value, rf"(?i)\b({_CODE})\b", 1))
    found = F.when(out != "", out)
    for sign, code in reversed(SIGNS.items()):
        found = F.when(F.contains(value, F.lit(sign)), code).otherwise(found)
    return found


def price_range(value: Column) -> Column:
    """struct(price_min, price_max) of texts such as "a - b" and "a to b"; null otherwise."""
    low, high = (F.regexp_extract(value, r"([0-9]+(?:\.[0-9]+)?)\s*(?:-|to)\s*[$€£]?\s*([0-9]+(?:\.[0-9]+)?)", i) for i in (1, 2))
    return F.when(low != "", F.struct(low.cast("double").alias("price_min"), high.cast("double").alias("price_max")))


def availability(value: Column) -> Column:
    """in_stock, limited_stock, out_of_stock or preorder: by schema.org's name (which gives pre_order), the state itself, yes
    or no, or the longest phrase contained; other text stays, trimmed."""
    text = F.trim(F.regexp_replace(value, r"\s+", " "))
    low = F.lower(text)
    name = F.regexp_replace(F.regexp_replace(low, "/+$", ""), r"^(https?://)?schema\.org/", "")
    state = F.regexp_replace(low, "[- ]", "_")
    found = text
    for phrase, own in sorted(((p, s) for s, ps in AVAILABILITY.items() for p in ps), key=lambda x: len(x[0])):
        found = F.when(F.contains(low, F.lit(phrase)), own).otherwise(found)
    found = F.when(low.isin("true", "1", "yes"), "in_stock").when(low.isin("false", "0", "no"), "out_of_stock").otherwise(found)
    found = F.when(state.isin(list(AVAILABILITY)), state).otherwise(found)
    for whole, own in AVAILABILITY_NAMES.items():
        found = F.when(name == whole, own).otherwise(found)
    return found


def amount_usd(amount: Column, currency: Column, rates: dict[str, float]) -> Column:
    """An amount in dollars by a fixed table of rates; null without a rate."""
    rate = F.lit(None).cast("double")
    for code, one in rates.items():
        rate = F.when(F.upper(currency) == code, one).otherwise(rate)
    return amount * rate


def barcode(value: Column) -> Column:
    """The digits of a code of 8, 12, 13 or 14 digits, written with blanks and hyphens at most."""
    digits = F.regexp_replace(value, r"[\s-]", "")
    return F.when(value.rlike(r"^[0-9\s-]+$") & F.length(digits).isin(8, 12, 13, 14), digits)


def sku(value: Column) -> Column:
    """A stock code without a draft's prefix; none of structured text, of a draft's long number, nor of long runs of letters and
    digits that only track a visit."""
    text = F.trim(value)
    code = F.trim(F.regexp_replace(text, "(?i)^(?:" + "|".join(DRAFTS) + ")[-_]+", ""))
    tracking = (F.length(code) > 20) & code.rlike("^[A-Za-z0-9]+$") & code.rlike("[A-Za-z]") & code.rlike("[0-9]")
    drafted = (code != text) & code.rlike("^[0-9]{10,}$")
    return F.when((code != "") & ~code.rlike(r"^[{\[]") & ~drafted & ~tracking, code)


def salary_text(value: Column) -> Column:
    """A JSON salary as "currency least - most unit", with what of it there is; null without an amount."""
    at = lambda path: F.nullif(F.trim(F.get_json_object(value, path)), F.lit(""))
    currency = F.coalesce(at("$.currency"), at("$.salaryCurrency"), at("$.currencyCode"))
    numbers = F.coalesce(F.nullif(F.concat_ws(" - ", at("$.value.minValue"), at("$.value.maxValue")), F.lit("")), at("$.value.value"))
    plain = F.when(~at("$.value").startswith("{"), at("$.value"))
    return F.when(numbers.isNotNull(), F.concat_ws(" ", currency, numbers, at("$.value.unitText"))).when(plain.isNotNull(), F.concat_ws(" ", currency, plain))
