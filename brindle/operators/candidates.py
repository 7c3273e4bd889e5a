"""Candidate values for a record's fields out of any JSON: a walk level by level, and payloads read by prioritised paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.once import once
from brindle.functions.text import field_key

#: Levels a walk goes down.
DEPTH = 8
# Keys under which variants are listed, types whose own names and pictures aren't the product's, those fields, and keys that name a labelled value.
VARIANTS = ("has_variant", "variants")
OTHERS = ("brand", "organization", "person", "review", "reviewrating")
NOT_OF_OTHERS = ("additional_images", "description", "image_url", "title", "url")
LABELS, LABELLED = ("FieldName", "fieldName", "field_name"), ("field_value", "field_values")
#: Keys of which a payload of no known kind needs ``SIGNATURE_LEAST`` at its first two levels to count as one of a product.
SIGNATURE = ("availability", "brand", "brand_name", "category", "currency", "description", "image", "images", "name", "price", "product_name", "sku", "title", "url", "variants", "vendor")
SIGNATURE_LEAST = 3


def _text(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def candidates(rows: DataFrame, key: str, value: str, aliases: Mapping[str, str], depth: int = DEPTH) -> DataFrame:
    """(key, field, path, value) of every scalar in the VARIANT column ``value`` whose key is an alias of a field.

    The walk opens one level of a row's values at a time, in one expression: scalars are put aside once, objects and lists are opened
    until there are none or ``depth`` levels are down; what lies deeper gives none. Nothing is shuffled.
    A key counts by its snake-case form, for list items the
    list's key. What is below variants isn't a candidate of the product, nor are names, texts, pictures and addresses of objects
    typed as one of ``OTHERS``; the name of an object whose key is an alias of brand is a brand. The names of a
    breadcrumb list make one category, and no other candidates; of a property with a name and a value, in
    additionalProperty or as field name and value, the name is the key. Blank values, nulls and unknown keys give no rows.
    """
    other = rf"(?:^|[ /#])(?:{'|'.join(OTHERS)})(?: |$)"
    known = F.create_map(*(F.lit(x) for pair in {**aliases, "brand": "brand", "category": "category"}.items() for x in pair))
    none = F.lit(None).cast("string")
    schema = lambda v: F.substring(F.schema_of_variant(v), 1, 5)
    made = lambda v, path, name, variant, other: F.struct(v.alias("v"), schema(v).alias("schema"), path.alias("path"), name.alias("name"), variant.alias("variant"), other.alias("other"))

    def of_list(n: Column) -> Column:
        items = F.try_variant_get(n["v"], "$", "array<variant>")
        return F.transform(items, lambda v, i: made(v, F.array_append(n["path"], i.cast("string")), n["name"], n["variant"], n["other"]))

    def of_object(n: Column) -> Column:
        kind = F.lower(F.coalesce(F.array_join(F.try_variant_get(n["v"], "$['@type']", "array<string>"), " "), _text(n["v"], "$['@type']"), F.lit("")))
        crumbs = F.filter(F.transform(F.try_variant_get(n["v"], "$.itemListElement", "array<variant>"), lambda c: F.trim(F.coalesce(_text(c, "$.name"), _text(c, "$.item.name")))), lambda t: t != "")
        trail = once(crumbs, lambda names: F.when(F.size(names) > 0, F.parse_json(F.to_json(F.struct(F.array_join(names, " > ").alias("category"))))))
        labelled = F.when((n["name"] == "additional_property") & F.variant_get(n["v"], "$.value", "variant").isNotNull(), _text(n["v"], "$.name"))
        label = F.coalesce(labelled, *(_text(n["v"], f"$.{x}") for x in LABELS))
        said = lambda kind: F.struct(kind.rlike(other).alias("other"), F.contains(kind, F.lit("breadcrumblist")).alias("crumbs"), label.alias("label"), field_key(label).alias("labelled"), (known[n["name"]] == "brand").alias("brand"))

        def opened(o: Column) -> Column:
            def child(e: Column) -> Column:
                def of_key(own: Column) -> Column:
                    name = (
                        F.when(o["label"].isNotNull() & own.isin("value", *LABELLED), o["labelled"]).when(o["label"].isNotNull() | e["key"].startswith("@"), none)
                        .when((own == "name") & o["brand"], F.lit("brand")).otherwise(own)
                    )
                    return made(e["value"], F.array_append(n["path"], e["key"]), name, n["variant"] | F.coalesce(own.isin(*VARIANTS), F.lit(False)), o["other"])

                return once(field_key(e["key"]), of_key)

            whole = F.when(o["crumbs"], trail).otherwise(n["v"])
            return F.transform(F.map_entries(F.try_variant_get(whole, "$", "map<string,variant>")), child)

        return once(once(kind, said), opened)

    def opened(acc: Column) -> Column:
        below = F.filter(F.flatten(F.array_compact(F.transform(acc["open"], lambda n: F.when(n["schema"] == "OBJEC", of_object(n)).otherwise(of_list(n))))), lambda n: ~n["variant"])

        def sorted_out(nodes: Column) -> Column:
            nested = lambda n: n["schema"].isin("OBJEC", "ARRAY")
            field = lambda n: F.struct(known[n["name"]].alias("field"), F.array_join(n["path"], "/").alias("path"), F.trim(_text(n["v"])).alias("value"), n["other"].alias("other"))
            told = F.filter(F.transform(F.filter(nodes, lambda n: ~nested(n) & n["name"].isNotNull()), field), lambda f: f["field"].isNotNull() & (f["value"] != "") & ~(f["other"] & f["field"].isin(*NOT_OF_OTHERS)))
            return F.struct(F.filter(nodes, nested).alias("open"), F.concat(acc["told"], told).alias("told"))

        return F.when(F.size(acc["open"]) == 0, acc).otherwise(once(below, sorted_out))

    root = once(F.col(value), lambda v: made(v, F.array().cast("array<string>"), none, F.lit(False), F.lit(False)))
    start = F.struct(F.filter(F.array(root), lambda n: n["schema"].isin("OBJEC", "ARRAY")).alias("open"), F.array().cast("array<struct<field:string,path:string,value:string,other:boolean>>").alias("told"))
    told = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, lambda acc, _: opened(acc), lambda acc: acc["told"])
    return rows.select(key, F.inline(told)).select(key, "field", "path", "value")


@dataclass(frozen=True)
class Mapped:
    """How payloads of one kind are read: each of ``required`` needs one path with a value; a field takes its first path with one."""

    name: str
    required: Sequence[Sequence[str]]
    fields: Mapping[str, Sequence[str]]
    families: Sequence[str] = ()
    tokens: Sequence[str] = ()


def under(roots: Sequence[str], names: Sequence[str]) -> list[str]:
    """All names below each root, root by root; '' is the payload itself."""
    return [f"{root}.{name}" if root else name for root in roots for name in names]


_PRODUCT, _JOB = ("product", "item", "data.product", ""), ("posting", "job", "position", "data.job", "data.posting", "")
_PRICE = ("price.current", "price.value", "price.amount", "offers.price", "price")
#: The paths of product and job payloads, made from where such an object stands and what its keys are called.
PRODUCT = Mapped(
    "product", (under(_PRODUCT, ("title", "name")), [*under(_PRODUCT, _PRICE), *under(_PRODUCT, ("sku",))]),
    {
        "title": under(_PRODUCT, ("title", "name")), "brand": under(_PRODUCT, ("brand.name", "brand", "vendor.name", "vendor")), "sku": under(_PRODUCT, ("sku",)), "price": under(_PRODUCT, _PRICE),
        "currency": under(_PRODUCT, ("price.currency", "currency", "offers.priceCurrency")), "image_url": under(_PRODUCT, ("image.url", "image", "images[0].url", "images[0]")),
    },
    families=("shopify", "nextjs"), tokens=("/products/", "/product/", "product.js", "/variants/", "/cart.js"),
)
JOB = Mapped(
    "job", (under(_JOB, ("title", "name")), under(_JOB, ("description", "content"))),
    {
        "title": under(_JOB, ("title", "name")), "company": under(_JOB, ("organization.name", "company.name", "company")), "location": under(_JOB, ("location.name", "locations[0].name", "location")),
        "apply_url": under(_JOB, ("applyUrl", "apply_url")), "posted_date": under(_JOB, ("datePosted", "postedAt", "publishedAt")), "description": under(_JOB, ("description", "content")),
    },
    tokens=("/jobs/", "/job_posts/", "/postings/", "/positions/", "/requisition/", "/careers/"),
)


def first_value(body: Column, paths: Sequence[str]) -> Column:
    """The first path's value that isn't missing, null, or an empty text, list or object; lists and objects as JSON."""

    values = F.array_compact(F.array(*(F.try_variant_get(body, f"$.{path}", "variant") for path in paths)))
    texts = F.transform(values, lambda v: F.when(_is(v, "OBJECT") | _is(v, "ARRAY"), F.to_json(v)).otherwise(_text(v)))
    return F.get(F.filter(texts, lambda text: ~text.isin("", "[]", "{}")), F.lit(0))


def signature_keys(body: Column) -> Column:
    """How many of ``SIGNATURE`` are keys of an object or of an object directly below it."""
    keys = lambda v: F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    below = lambda v: F.flatten(F.transform(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: F.coalesce(keys(x), F.array().cast("array<string>"))))
    own = once(body, lambda v: F.array_distinct(F.concat(keys(v), below(v))))
    return F.coalesce(F.size(F.array_intersect(F.transform(own, field_key), F.array(*map(F.lit, SIGNATURE)))), F.lit(0))


def payload_priority(kind: Column, family: Column, url: Column, body: Column, specs: Sequence[Mapped]) -> Column:
    """Where a payload stands among a page's: by its kind, 20 more for a family and 10 more for an address that one of the specs names."""
    families, tokens = [f for s in specs for f in s.families], [t for s in specs for t in s.tokens]
    kind, family, url = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (kind, family, url))
    generic = F.when(signature_keys(body) >= SIGNATURE_LEAST, 22).otherwise(5)
    score = F.when(kind == "graphql", 30).when(kind.isin("job_api", "product_api"), 28).when(kind == "generic_json", generic).otherwise(0)
    token = reduce(lambda a, b: a | b, (F.contains(url, F.lit(t)) for t in tokens), F.lit(False))
    return score + F.when(family.isin(*families), 20).otherwise(0) + F.when(token, 10).otherwise(0)


def payload_fields(payloads: DataFrame, key: str, specs: Sequence[Mapped] = (PRODUCT,)) -> DataFrame:
    """(key, position, priority, spec, fields map) of each payload (key, position, kind, family, url, body) that one of the specs reads.

    The first spec counts whose required paths all have a value and that finds a field. Bodies that aren't JSON, or neither object
    nor list, give no rows. One pass over the payloads, without a shuffle.
    """

    def mapped(v: Column, spec: Mapped) -> Column:
        asked = list(dict.fromkeys(map(tuple, [*spec.fields.values(), *spec.required])))

        def made(found: Column) -> Column:
            of = lambda paths: F.get(found, F.lit(asked.index(tuple(paths))))
            pairs = F.filter(F.array(*(F.struct(F.lit(f).alias("key"), of(paths).alias("value")) for f, paths in spec.fields.items())), lambda p: p["value"].isNotNull())
            fits = reduce(lambda a, b: a & b, (of(paths).isNotNull() for paths in spec.required), F.lit(True))
            return F.when(fits, once(pairs, lambda p: F.when(F.size(p) > 0, F.struct(F.lit(spec.name).alias("spec"), F.map_from_entries(p).alias("fields")))))

        return once(F.array(*(first_value(v, paths) for paths in asked)), made)

    def read(v: Column) -> Column:
        m = F.when(_is(v, "OBJECT") | _is(v, "ARRAY"), F.coalesce(*(mapped(v, s) for s in specs)))
        return once(m, lambda m: F.when(m.isNotNull(), F.struct(payload_priority(F.col("kind"), F.col("family"), F.col("url"), v, specs).alias("priority"), m["spec"].alias("spec"), m["fields"].alias("fields"))))

    # what is read comes out of a generator, so that no filter works it out again
    return payloads.select(key, "position", F.inline(F.array_compact(F.transform(F.array(F.try_parse_json("body")), read))))


def best_fields(mapped: DataFrame, key: str) -> DataFrame:
    """(key, field, value, position): of each field the value of the payload of highest priority, then first position; combined map-side."""
    each = mapped.select(key, "position", "priority", F.explode("fields").alias("field", "value"))
    rank = F.struct(-F.col("priority"), "position")
    return each.groupBy(key, "field").agg(F.min_by("value", rank).alias("value"), F.min_by("position", rank).alias("position"))
