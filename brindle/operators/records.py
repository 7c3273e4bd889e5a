"""Record-level operators: firewall, confidence, audit, fingerprints, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import collapsed

# Fields of a product record that may be published, and weights of its confidence.
PUBLIC = ["brand", "price", "size", "title", "type"]
WEIGHTS = {"title": 3.0, "price": 2.0, "brand": 1.5, "type": 1.0, "size": 0.5}


def firewall(records: DataFrame) -> DataFrame:
    """(record_id, field, value, keep, reason) of records with ``data map<string,string>``: each entry kept or rejected with a reason.

    Rules in order: internal names (_...), empty values, fields outside the contract, a price that is no number.
    """
    each = records.select("record_id", F.explode("data").alias("field", "value"))
    reason = (
        F.when(F.col("field").startswith("_"), "internal").when(F.coalesce(F.trim("value"), F.lit("")) == "", "empty").when(~F.col("field").isin(PUBLIC), "not_allowed")
        .when((F.col("field") == "price") & F.col("value").try_cast("double").isNull(), "shape")
    )
    return each.select("record_id", "field", "value", reason.isNull().alias("keep"), F.coalesce(reason, F.lit("")).alias("reason"))


def public_map(data: Column) -> Column:
    """The entries of a map that may leave: not empty, not internal."""
    return F.map_filter(data, lambda k, v: ~k.startswith("_") & (F.coalesce(F.trim(v), F.lit("")) != ""))


def confidence(fields: dict[str, Column]) -> Column:
    """Weighted share of good fields: an absent one counts 0, a title under 4 characters, a price without a digit lose 0.35 and 0.45."""
    total = sum(WEIGHTS.values())
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        value = fields[name]
        penalty = F.lit(0.0)
        if name == "title":
            penalty = F.when(F.length(value) < 4, 0.35).otherwise(0.0)
        if name == "price":
            penalty = F.when(~value.rlike("[0-9]"), 0.45).otherwise(0.0)
        score = score + F.when(F.coalesce(F.trim(value), F.lit("")) != "", weight * (1 - penalty)).otherwise(0.0)
    return F.round(score / total, 4)


def content_fingerprint(fields: dict[str, Column], url: Column) -> Column:
    """SHA-256 of the record's identity as compact JSON with sorted keys: case-folded, blanks collapsed, empty ones left out;
    of the URL if none is left. For ASCII values."""
    pairs = F.filter(
        F.array(*(F.struct(F.lit(k).alias("k"), F.lower(collapsed(v)).alias("v")) for k, v in sorted(fields.items()))), lambda p: F.coalesce(p["v"], F.lit("")) != ""
    )
    text = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["k"], F.lit('":"'), F.replace(p["v"], F.lit('"'), F.lit('\\"')), F.lit('"'))), ",")
    return F.sha2(F.when(F.size(pairs) > 0, F.concat(F.lit("{"), text, F.lit("}"))).otherwise(F.concat(F.lit('{"url":"'), url, F.lit('"}'))), 256)


def audit(rows: DataFrame, key: str, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(key, category, severity, field) of each broken rule; a rule is (category, severity, field, broken)."""
    issues = F.array(*(F.when(bad, F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(f).alias("field"))) for c, s, f, bad in rules))
    return rows.select(key, F.explode(F.array_compact(issues)).alias("i")).select(key, "i.*")


def merge_variants(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row a key: the row with most filled fields gives each field, poorer ones fill its gaps (by ``ord``). One shuffle, no window."""
    rich = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    order = F.struct((-rich).alias("r"), F.col("ord").alias("o"))
    ranked = rows.withColumn("_order", order)
    pick = lambda f: F.min(F.when(F.col(f).isNotNull(), F.struct(F.col("_order"), F.col(f).alias("v"))))["v"].alias(f)
    return ranked.groupBy(*key).agg(F.count("*").alias("merged"), *map(pick, fields))


def verdict(listing: Column, blocked: Column, n: Column) -> Column:
    """What became of an address with n records."""
    return F.when(n > 0, F.when(blocked, "partial").otherwise("success")).when(blocked, "blocked").when(listing, "listing_detection_failed").otherwise("empty")


# States of a run, what each may become, and old names of states.
TRANSITIONS = {
    "pending": ["running", "killed"], "running": ["paused", "completed", "killed", "failed", "proxy_exhausted"], "paused": ["running", "killed"],
    "completed": [], "killed": [], "failed": [], "proxy_exhausted": [],
}
OLD_STATES = {"cancelled": "killed", "degraded": "failed"}


def run_status(value: Column) -> Column:
    """A state in today's name; null if there is none such."""
    low = F.lower(F.trim(value))
    for old, new in OLD_STATES.items():
        low = F.when(low == old, new).otherwise(low)
    return F.when(low.isin(list(TRANSITIONS)), low)


def legal_transition(current: Column, target: Column) -> Column:
    """Whether a run may go from one state to another; staying is legal, unknown states aren't."""
    legal = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in [a, *bs]]
    return F.coalesce(F.concat(current, F.lit(">"), target).isin(legal), F.lit(False))


def variant_identity(variant_id: Column, sku: Column, options: Column) -> Column:
    """id:, sku: or options: with sorted pairs, by what a variant has first; null without any."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    pairs = F.filter(F.transform(F.map_entries(options), lambda e: F.struct(F.trim(e["key"]).alias("k"), filled(e["value"]).alias("v"))), lambda e: (e["k"] != "") & e["v"].isNotNull())
    listed = F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda e: F.concat(e["k"], F.lit("="), e["v"])), "|"), F.lit(""))
    return F.coalesce(F.concat(F.lit("id:"), filled(variant_id)), F.concat(F.lit("sku:"), filled(sku)), F.concat(F.lit("options:"), listed))


def other_images(images: Column, primary: Column) -> Column:
    """Images distinct but for case, blanks and the primary one left out, in order."""
    from brindle.functions.text import distinct_ignoring_case

    return F.filter(distinct_ignoring_case(images), lambda x: (F.trim(x) != "") & (F.lower(x) != F.lower(primary)))


def coverage(requested: Column, data: Column) -> Column:
    """struct(requested, found, missing) of the requested fields that data has a value for."""
    missing = F.filter(requested, lambda f: F.coalesce(F.trim(F.try_element_at(data, f)), F.lit("")) == "")
    return F.struct(F.size(requested).alias("requested"), (F.size(requested) - F.size(missing)).alias("found"), missing.alias("missing"))


def surface_fields(canonical: list[str], requested: list[str]) -> list[str]:
    """The fields of a surface: the canonical ones, the URL, then what is requested; each once."""
    return list(dict.fromkeys([*canonical, "url", *requested]))


def to_contract(data: Column, fields: list[str], aliases: dict[str, str]) -> Column:
    """A map with the fields of the surface only: a field's own value, else that of its first alias with one."""
    pairs = []
    for f in fields:
        value = F.coalesce(*(F.nullif(F.trim(F.try_element_at(data, F.lit(name))), F.lit("")) for name in [f, *(a for a, c in aliases.items() if c == f)]))
        pairs.append(F.struct(F.lit(f).alias("key"), value.alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def populated(data: Column) -> Column:
    """How many fields but the URL have a value."""
    return F.size(F.map_filter(data, lambda k, v: (k != "url") & (F.coalesce(F.trim(v), F.lit("")) != "")))


def progress(results: DataFrame, run: str, n: str, verdicts: str, planned: Column, counted: dict[str, str]) -> DataFrame:
    """(run, done, records, progress in per cent, a count for each of ``counted``): one aggregate with map-side sums."""
    done = F.count("*")
    return results.groupBy(run).agg(
        done.alias("done"), F.sum(n).alias("records"), F.floor(100 * done / F.greatest(done, F.any_value(planned))).cast("int").alias("progress"), *(F.count_if(F.col(verdicts) == v).alias(name) for name, v in counted.items())
    )
