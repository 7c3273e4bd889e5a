"""Candidates out of any JSON against a walk by recursion, and payloads by priority."""

import json
import random

from pyspark.sql import functions as F

from brindle.operators import candidates

ALIASES = {"a": "title", "b": "price", "c": "sku", "item_size": "size"}


def walked(spark, bodies, aliases=ALIASES, depth=8):
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string").select("id", F.lit("x").alias("path"), F.lit(1).alias("name"), F.try_parse_json("body").alias("v"))
    return sorted((r["id"], r["field"], r["path"], r["value"]) for r in candidates.candidates(rows, "id", "v", aliases, depth).collect())


def recursive(value, path=(), name=None, variant=False):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from recursive(v, (*path, k), None if k.startswith("@") else k, variant or k == "variants")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from recursive(v, (*path, str(i)), name, variant)
    elif name in ALIASES and value is not None and not variant and str(value).strip():
        yield ALIASES[name], "/".join(path), {True: "true", False: "false"}.get(value, str(value).strip()) if isinstance(value, bool) else str(value).strip()


def made(rng, deep):
    kind = rng.choice(["dict", "dict", "list", "leaf"] if deep else ["leaf"])
    if kind == "dict":
        return {rng.choice(["a", "b", "c", "d", "variants", "@id"]): made(rng, deep - 1) for _ in range(rng.randrange(4))}
    if kind == "list":
        return [made(rng, deep - 1) for _ in range(rng.randrange(3))]
    return rng.choice([1, "x", " y ", "", None, True, "12.5"])


def test_walk_equals_recursion(spark):
    rng = random.Random(3)
    values = [{"a": made(rng, 6)} for _ in range(150)]
    got = walked(spark, [json.dumps(v) for v in values])
    assert got == sorted((i, *c) for i, v in enumerate(values) for c in recursive(v))


def test_depth_and_odd_bodies(spark):
    assert walked(spark, ['{"d":{"d":{"a":1}}}'], depth=2) == [] and walked(spark, ['{"d":{"d":{"a":1}}}'], depth=3) == [(0, "title", "d/d/a", "1")]
    assert walked(spark, [None, "", "[]", "{}", "null", '"a"', "7", "{broken", '[[{"a":null}]]']) == []
    assert walked(spark, []) == []


def test_labels_types_and_brands(spark):
    bodies = [
        '{"additionalProperty":[{"name":"Item size","value":"L"},{"name":"unknown","value":"no"},{"value":"no name"}]}', '{"specs":[{"fieldName":"itemSize","fieldValue":"M"},{"field_name":"c","field_values":["1","2"]}]}',
        '{"a":"T","maker":{"@type":"https://schema.org/Organization","a":"not","c":"S"},"brand":{"name":"Acme"}}', '{"x":{"@type":["Thing","BreadcrumbList"],"itemListElement":[{"name":"Home"},{"item":{"name":" Chairs "}},{"name":""}]},"a":"t"}',
        '{"x":{"@type":"BreadcrumbList","a":"no"}}',
    ]
    assert walked(spark, bodies) == [
        (0, "size", "additionalProperty/0/value", "L"), (1, "size", "specs/0/fieldValue", "M"), (1, "sku", "specs/1/field_values/0", "1"), (1, "sku", "specs/1/field_values/1", "2"),
        (2, "brand", "brand/name", "Acme"), (2, "sku", "maker/c", "S"), (2, "title", "a", "T"), (3, "category", "x/category", "Home > Chairs"), (3, "title", "a", "t"),
    ]


PAYLOADS = "id int, position int, kind string, family string, url string, body string, v int, spec int"


def mapped(spark, *rows, specs=(candidates.PRODUCT,)):
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], PAYLOADS)
    return candidates.payload_fields(frame, "id", specs)


def test_payload_priorities(spark):
    body = '{"title":"t","price":1}'
    rows = [
        (1, 0, "graphql", None, None, body), (1, 1, "product_api", "NextJS", "https://x/PRODUCTS/1", body), (1, 2, "generic_json", "", "", body), (1, 3, "generic_json", "", "", '{"title":"t","price":1,"x":{"Brand Name":"b"}}'), (1, 4, "other", "", "", body),
        (1, 5, None, None, None, body),
    ]
    assert {r["position"]: r["priority"] for r in mapped(spark, *rows).collect()} == {0: 30, 1: 58, 2: 5, 3: 22, 4: 0, 5: 0}


def test_payload_paths_and_required_groups(spark):
    rows = [
        (1, 0, "", "", "", '{"product":{"title":"","name":"n","price":{"value":5}},"title":"later"}'), (1, 1, "", "", "", '{"title":"t"}'), (1, 2, "", "", "", '{"title":"t","price":[],"sku":{}}'), (1, 3, "", "", "", "[1]"), (1, 4, "", "", "", "no"), (1, 5, "", "", "", None),
        (1, 6, "", "", "", '{"item":{"name":"i","sku":"s","images":[{"url":"u"}],"brand":["x","y"]}}'),
    ]
    got = {r["position"]: r["fields"] for r in mapped(spark, *rows).collect()}
    assert got == {0: {"title": "n", "price": "5"}, 6: {"title": "i", "sku": "s", "image_url": "u", "brand": '["x","y"]'}}


def test_first_spec_and_best_payload(spark):
    both = '{"title":"t","price":1,"description":"d","company":"c"}'
    got = mapped(spark, (1, 0, "", "", "", both), specs=(candidates.JOB, candidates.PRODUCT)).collect()
    assert [r["spec"] for r in got] == ["job"]
    rows = [(1, 0, "", "", "", '{"title":"low","price":1,"sku":"s0"}'), (1, 1, "graphql", "", "", '{"title":"high","price":2}'), (1, 2, "graphql", "", "", '{"title":"late","price":3,"sku":"s2"}'), (2, 0, "", "", "", "{}")]
    best = sorted((r["id"], r["field"], r["value"], r["position"]) for r in candidates.best_fields(mapped(spark, *rows), "id").collect())
    assert best == [(1, "price", "2", 1), (1, "sku", "s2", 2), (1, "title", "high", 1)]
    assert candidates.best_fields(mapped(spark), "id").count() == 0


def test_payloads_are_read_once_and_spread(spark, capsys):
    from brindle.plans import catalogue

    found = catalogue.QUERIES["payload_best_fields"](spark, "/root/testdata/sf0.001")
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("parseJson") == 1 and "REPARTITION_BY_NUM" in plan


def test_walk_is_one_expression_over_spread_rows(spark, capsys):
    from brindle.plans import catalogue

    catalogue.QUERIES["json_candidates"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("Generate") == 1 and "REPARTITION_BY_NUM" in plan
