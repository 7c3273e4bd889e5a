"""Filters of variants against their rules read out in plain loops, and on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import variants as v

ROWS = "product string, variant int, options map<string,string>, " + ", ".join(f"{c} string" for c in [*v.FIELDS, "parent_title", "parent_color", "parent_price", "parent_currency", "_set", "n"])


def row(product, variant, options=None, **own):
    return {"product": product, "variant": variant, "options": options} | own


def frame(spark, rows):
    names = [c.split()[0] for c in ROWS.replace("map<string,string>", "m").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ROWS)


def kept(spark, f, rows):
    return sorted(r["variant"] for r in f(frame(spark, rows)).collect())


def test_dominated_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        axes = rng.sample(["size", "color", "fit", "cut"], rng.randrange(5))
        rows.append(row(rng.choice(["a", "b", "c", None]) if i % 3 else "hot", i, {x: rng.choice(["1", "2", " ", None]) for x in axes} if i % 11 else None))
    sets = {r["variant"]: {(k, x) for k, x in (r["options"] or {}).items() if x and x.strip()} for r in rows}
    want = [r["variant"] for r in rows if r["product"] is None or not sets[r["variant"]] or not any(o["product"] == r["product"] and sets[r["variant"]] < sets[o["variant"]] for o in rows)]
    assert kept(spark, v.without_dominated, rows) == sorted(want)


def test_rows_of_other_products(spark):
    own = {"parent_title": "The Oak Table"}
    rows = [
        row("a", 1, {}, title="Oak table large", **own), row("a", 2, {}, title="Steel lamp", **own), row("a", 3, {}, title="Steel", **own), row("a", 4, {"color": "Steel"}, title="Steel lamp", **own), row("a", 5, None, title=None, **own),
        row("a", 6, {}, title="Steel lamp", parent_title=None), row("a", 7, {"color": "Deep Blue Garden Chair Cover (new)"}, **own), row("a", 8, {"color": "Deep Blue Garden Chair Cover"}, **own),
    ]
    assert kept(spark, v.without_foreign, rows) == [1, 3, 4, 5, 6, 8]
    assert kept(spark, lambda df: v.without_foreign(df, ["chair"]), rows) == [1, 3, 4, 5, 6]


def test_rows_without_options(spark):
    rows = [
        row("two", 1, {"size": "1"}), row("two", 2, {"size": "2"}), row("two", 3, {}, sku="s"), row("one", 4, {"size": "1"}), row("one", 5, None, sku="s"), row("one", 6, {"size": " "}, url="u"), row("one", 7, {}), row("none", 8, {}), row(None, 9, {}), row(None, 10, {"size": "1"}),
    ]
    assert kept(spark, v.without_axisless, rows) == [1, 2, 4, 5, 6, 8, 10]


@pytest.mark.parametrize(("parent", "more", "want"), [("Red", [], [1, 2]), ("blue", [], [1, 2, 3, 4]), (None, [], [1, 2, 3, 4]), ("red", [{"size": "L", "color": "red"}], [1, 2, 3, 4, 5]), ("red", [{"color": "blue"}], [1, 2, 3, 4, 5])])
def test_colours_beside_sizes(spark, parent, more, want):
    options = [{"size": "S"}, {"size": "M"}, {"color": "red"}, {"color": " RED"}, *more]
    assert kept(spark, v.without_colour_only, [row("a", i + 1, o, parent_color=parent) for i, o in enumerate(options)]) == want


def test_skus_of_parents(spark):
    rows = [
        row("a", 1, {"size": "XL"}, sku="AB1"), row("a", 2, {"size": "XL"}, sku="ab1-xl", price="3"), row("a", 3, {"size": "M"}, sku="AB1"), row("a", 4, {}, sku="AB12-M"), row("b", 5, {"size": "S"}, sku="Q", price="1"), row("b", 6, {}, sku="Q/S"),
        row("a", 7, {"size": "XL"}, sku="AB1", price="1", url="u", title="t"), row(None, 8, {"size": "XL"}, sku="Z"), row(None, 9, {"size": "XL"}, sku="Z-XL", price="3"), row("a", 10, {"size": "XL"}, sku=None),
    ]
    assert kept(spark, v.without_parent_skus, rows) == [2, 3, 4, 5, 6, 7, 8, 9, 10]


def test_bare_numbers(spark):
    rows = [
        row("gone", 1, {"size": "1"}), row("gone", 2, {"size": "22"}, price="5", parent_price="5"), row("price", 3, {"size": "1"}, price="6", parent_price="5"), row("price", 4, {"size": "2"}), row("text", 5, {"size": "XL"}), row("sku", 6, {"size": "1"}, sku="s"), row("null", 7, None),
    ]
    assert kept(spark, v.without_bare_numbers, rows) == [3, 4, 5, 6, 7]


def test_all_filters(spark):
    own = {"parent_title": "Oak table", "parent_color": "red"}
    rows = [row("p", 1, {"size": "S", "color": "red"}, **own), row("p", 2, {"size": "S"}, **own), row("p", 3, {}, sku="x", **own), row("p", 4, {"size": "M", "color": "red"}, title="steel lamp", **own), row("q", 5, {"size": "4"}, **own), row("q", 6, {"size": "5"}, **own)]
    assert kept(spark, v.pruned, rows) == [1]
    assert v.pruned(frame(spark, rows).limit(0)).count() == 0
    assert v.pruned(frame(spark, rows)).columns == frame(spark, rows).columns and frame(spark, rows).select(F.count("*")).first()[0] == 6
