import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest

from brindle.functions import text
from brindle.operators import taxonomy

WORDS = ["chair", "oak", "boots", "shirt", "furniture", "red", "blue", "lamps", "tables", "box", "boxes", "berries", "underwear", "glass", "bag", "shopping"]
BLOCKS = [(["shirt"], ["furniture"]), (["red boot"], ["underwear"])]
SCHEMA = "product_id long, value string, first string, second string, third string, category string, score int, _token string"


def one(token):
    for tail, short, new in (("ies", 4, "y"), ("sses", 4, "ss"), ("xes", 4, "x"), ("ches", 4, "ch"), ("shes", 4, "sh")):
        if token.endswith(tail) and len(token) > short:
            return token[: -len(tail)] + new
    return token[:-1] if len(token) > 3 and token.endswith("s") and not token.endswith("ss") else token


def bag(value):
    return {one(t) for t in re.findall("[a-z0-9]+", (value or "").lower())}


def brute(products, categories, most):
    out = []
    flat = lambda x: " ".join((x or "").lower().split())
    for key, value, *pools in products:
        paths = [c for c, _, _ in categories if flat(c) == flat(value)] if flat(value) else []
        leaves = [c for c, leaf, _ in categories if flat(leaf) == flat(value)] if flat(value) else []
        if paths or len(leaves) == 1:
            out.append((key, min(paths) if paths else leaves[0], 1.0 if paths else 0.92, "exact_match", 1))
            continue
        own, found = [bag(p) for p in pools], []
        for path, _, attributes in categories:
            theirs = bag(path)
            share = lambda a, b: len(a & b) / len(a) if a else 0.0
            shares = [share(p, theirs) for p in own]
            words = set().union(*own)
            score = shares[0] + 0.35 * shares[1] + 0.15 * shares[2] + 0.3 * share(words, bag(attributes) - theirs)
            if not shares[0]:
                score *= 0.6
            clash = any(any(bag(t) <= words for t in terms) and any(p in flat(path) for p in parts) for terms, parts in BLOCKS)
            if score >= 0.42 and not clash:
                found.append((-float(Decimal(repr(score)).quantize(Decimal("0.001"), ROUND_HALF_UP)), len(path), path))
        found.sort()
        out += [(key, path, -score, "scored_match", rank) for rank, (score, _, path) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_ranked_categories_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    some = lambda least, most: " ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))) or None
    categories = {}
    for _ in range(60):
        path = [rng.choice(WORDS).title() for _ in range(rng.randint(1, 4))]
        categories.setdefault(" > ".join(path), (path[-1], some(0, 4)))
    categories = [(c, *rest) for c, rest in categories.items()]
    products = [(i, rng.choice([None, "", categories[i % len(categories)][0].upper() + " ", some(1, 1)]), some(0, 2), some(0, 4), some(0, 2)) for i in range(250)]
    found = taxonomy.ranked_categories(spark.createDataFrame([(*p, "clash", 1, "") for p in products], SCHEMA), spark.createDataFrame([(*c, 7) for c in categories], "category string, leaf string, attributes string, product_id int"), 3, BLOCKS)
    rows = sorted(tuple(r) for r in found.select("product_id", "category", "score", "source", "rank").collect())
    want = brute(products, categories, 3)
    assert rows == want
    assert any(w[3] == "exact_match" for w in want) and any(w[4] == 3 for w in want)


def test_ranked_categories_of_odd_rows(spark):
    products = lambda rows: spark.createDataFrame([(*r, "", 0, "") for r in rows], SCHEMA)
    shelf = lambda rows: spark.createDataFrame(rows, "category string, leaf string, attributes string")
    run = lambda p, c: sorted(tuple(r) for r in taxonomy.ranked_categories(products(p), shelf(c)).select("product_id", "category", "score").collect())
    some = [("Home > Lamps", "Lamps", None)]
    assert run([], some) == run([(1, "Lamps", "lamp", "lamp", "lamp")], []) == []
    assert run([(None, None, "lamp", None, None), (1, None, None, None, None), (2, "", " ", "!", "?")], some) == []
    assert run([(1, None, "lamp", None, None)] * 3, [*some, *some, (None, "x", "y"), (" ", "lamp", "")]) == [(1, "Home > Lamps", 1.0)]
    assert run([(1, None, None, "lamp " * 9000, None)], some) == []
    assert run([(1, None, None, "lamp", "lamp")], [("Home > Lamps", "", None)]) == []
    assert run([(1, None, "shirts", "lamp", None)], [("Furniture > Shirts", "", None), ("Wear > Shirts", "", None)]) == [(1, "Wear > Shirts", 1.0)]


def test_singular(spark):
    words = ["berries", "ties", "glasses", "boxes", "benches", "dishes", "lamps", "bus", "gas", "glass", "s", "", "yes", "shoes"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in rows.select(text.singular(rows.w)).collect()] == [one(w) for w in words]


def test_products_with_the_same_tokens_are_asked_for_once(spark, capsys):
    from brindle.operators import matching

    products = spark.range(400).selectExpr("id AS product_id", "CASE id % 4 WHEN 0 THEN 'Red oak chair' WHEN 1 THEN 'chair, oak red' WHEN 2 THEN '' END AS text").coalesce(1)
    shelf = spark.createDataFrame([("oak chair",), ("red box",), ("glass lamp red",)], "category string")
    found = matching.taxonomy_match(products, shelf)
    assert sorted((r["product_id"], r["category"], r["score"], r["rank"]) for r in found.collect()) == [(i, c, s, n) for i in range(400) if i % 4 < 2 for c, s, n in (("oak chair", 1.0, 1), ("red box", 0.5, 2))]
    found.explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "partitionBy" not in plan and "windowspecdefinition(product_id" not in plan


def test_ranked_products_of_the_same_pools_share_one_ranking(spark, capsys):
    products = spark.range(60).selectExpr("id AS product_id", "'' AS value", "CASE WHEN id % 2 = 0 THEN 'oak chair' ELSE 'Chairs of OAK' END AS first", "'red' AS second", "'' AS third")
    shelf = spark.createDataFrame([("oak > chairs", "", "red"), ("lamps", "", "")], "category string, leaf string, attributes string")
    found = taxonomy.ranked_categories(products, shelf)
    got = {r["product_id"]: (r["category"], r["rank"]) for r in found.collect()}
    assert got == {i: ("oak > chairs", 1) for i in range(60)}
    found.explain()
    assert "windowspecdefinition(product_id" not in capsys.readouterr().out
