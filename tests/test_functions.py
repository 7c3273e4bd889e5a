import random
import re

import pytest
from pyspark.sql import functions as F

from brindle.functions import numbers, prices, text, urls
from brindle.operators import folds, matching, records
from brindle.sources import pages


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def priced(seed=11, n=60):
    """Amounts written in every notation, with and without a mark of money, and what each must give."""
    rng = random.Random(seed)
    for _ in range(n):
        whole, cents = rng.randrange(10 ** rng.randrange(1, 8)), rng.randrange(100)
        plain, english = f"{whole}.{cents:02d}", f"{whole:,}.{cents:02d}"
        swapped = english.translate(str.maketrans(",.", ".,"))
        fractions = {english: plain, swapped: plain, f"{whole},{cents:02d}": plain, plain: plain, f"000{plain}": plain, f"{whole},{cents % 10}": f"{whole}.{cents % 10}"}
        wholes = {str(whole), f"{whole:,}", f"{whole:,}".replace(",", ".")}
        mark = rng.choice(["{} " + rng.choice(prices.CODES), rng.choice(list(prices.SIGNS)) + "{}", rng.choice(prices.BESIDE_PRICES) + " {}", "Rs. {}", "{}" + rng.choice(list(prices.SIGNS))])
        for text, want in [*fractions.items(), *((w, str(whole)) for w in wholes)]:
            small = "." not in want and len(want) <= 3
            yield mark.format(text), want
            yield f"  {mark.format(text)}\t", want
            yield text, None if small else want
            yield f"+{text}", None if small else want
            yield f"{text},", None if small else want
            yield f"-{text}", None
            yield f"- {rng.choice(list(prices.SIGNS))} {text}", None
            yield f"-{rng.choice(prices.CODES)}{text}", None


def test_decimal_price(spark):
    given = [*priced(), *((x, None) for x in ("", " ", None, "word", "$", "$1.2.3", "$1,2.3.4", "€1.2,3,4")), ("$7,8,9", "78.9"), ("$.50", "50")]
    got = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(given)], "i int, v string").select("i", prices.decimal_price(F.col("v")).alias("p")).collect()
    wrong = [(given[r["i"]], r["p"]) for r in got if r["p"] != given[r["i"]][1]]
    assert not wrong and len(got) == len(given)


@pytest.mark.parametrize(("raw", "state"), [("http://schema.org/OutOfStock/", "out_of_stock"), ("schema.org/PreOrder", "pre_order"), ("only 2 left in stock", "limited_stock"), ("Low Stock", "limited_stock"), ("oos", "out_of_stock"), ("ready to ship now", "in_stock"), ("Unavailable today", "out_of_stock"), ("no", "out_of_stock"), ("back-order", "preorder"), ("next week", "next week"), (None, None)])
def test_availability(spark, raw, state):
    assert one(spark, prices.availability, raw) == state


@pytest.mark.parametrize(
    ("url", "domain"),
    [("https://www.Shop.example.com:443/a", "shop.example.com"), ("http://a.example:80", "a.example"), ("http://a.example:8080/x", "a.example:8080"), ("www.example.org/x", "example.org"), ("https://u:p@b.example/", "b.example"), ("", ""), (None, None)],
)
def test_normalize_domain(spark, url, domain):
    assert one(spark, urls.normalize_domain, url) == domain


@pytest.mark.parametrize(("url", "host"), [("http://a.b.example.com/", "example.com"), ("http://shop.foo.co.uk/", "foo.co.uk"), ("http://10.0.0.1/", "10.0.0.1"), ("https://a.b.com.cn/x", "b.com.cn"), ("https://y.x.co.kr", "x.co.kr"), ("https://tax.service.gov.uk", "service.gov.uk"), ("http://example.com", "example.com")])
def test_registrable_host(spark, url, host):
    assert one(spark, urls.registrable_host, url) == host


def test_strip_tracking(spark):
    assert one(spark, urls.strip_tracking, "http://a.example/x?utm_source=q&id=3&ref=z#top") == "http://a.example/x?id=3#top"
    assert one(spark, urls.strip_tracking, "http://a.example/x?ref=z") == "http://a.example/x"


def test_glued_addresses(spark):
    given = {"https://a.example/xhttps://b.example": True, "https://a.example/?u=https://b.example": True, "https://a.example, https://b.example": False, "https://a.example": False, "": False}
    assert {u: one(spark, urls.is_concatenated, u) for u in given} == given


def test_term_is_no_pattern(spark):
    assert [one(spark, lambda c: text.term_present(c, "c++ (new)"), x) for x in ("learn C++  (new) today", "cc (new)")] == [True, False]


def test_field_key(spark):
    assert [one(spark, text.field_key, x) for x in ("OriginalPrice", "image URL", "a & b", "ABCDef")] == ["original_price", "image_url", "a_b", "abc_def"]


def test_distinct_ignoring_case(spark):
    df = spark.createDataFrame([(["A", "b", "a", "B", "c"],)], "v array<string>")
    assert df.select(text.distinct_ignoring_case(F.col("v")).alias("r")).first()["r"] == ["A", "b", "c"]


def test_verdicts(spark):
    rows = [(1, 1, "success"), (1, 2, "success"), (2, 1, "success"), (2, 2, "error"), (3, 1, "blocked"), (3, 2, "odd"), (4, 1, ""), (5, 1, "odd")]
    got = {r["run"]: r["verdict"] for r in folds.run_verdicts(spark.createDataFrame(rows, "run int, idx int, verdict string"), "run").collect()}
    assert got == {1: "success", 2: "partial", 3: "blocked", 5: "odd"}


def test_pacing_equals_recurrence(spark):
    times = [0, 10, 5000, 5001, 5002, 20000]
    rows = folds.paced(spark.createDataFrame([("h", i, t) for i, t in enumerate(times)], "host string, i int, now int"), "host", "i", "now", 2000)
    slot, want = -(10**9), []
    for t in times:
        slot = max(t, slot + 2000)
        want.append(slot)
    assert [r["slot"] for r in rows.orderBy("i").collect()] == want


def test_firewall_and_variants(spark):
    rows = spark.createDataFrame([(1, {"title": "x", "_a": "1", "price": "many", "brand": "", "other": "y"})], "record_id int, data map<string,string>")
    assert {r["field"]: r["reason"] for r in records.firewall(rows).collect()} == {"title": "", "_a": "internal", "price": "shape", "brand": "empty", "other": "not_allowed"}
    variants = spark.createDataFrame([("k", 2, "red", None), ("k", 1, None, "M"), ("k", 3, "blue", "L")], "k string, ord int, color string, size string")
    r = records.merge_variants(variants, ["k"], ["color", "size"]).first()
    assert (r["merged"], r["color"], r["size"]) == (3, "blue", "L")


def test_filled_last_side_row_wins(spark):
    rows = spark.createDataFrame([("1", "Shoe", None), ("9", "Hat", None), ("8", "None", 3.0)], "id string, title string, price double")
    by_id = spark.createDataFrame([("1", 1.0, 1), ("1", 2.0, 2)], "key string, price double, ord int")
    by_title = spark.createDataFrame([("hat", 7.0, 1), ("shoe", 8.0, 2)], "key string, price double, ord int")
    assert {r["id"]: r["price"] for r in matching.filled(rows, by_id, by_title, "id", "title", ["price"]).collect()} == {"1": 2.0, "9": 7.0, "8": 3.0}


PAGE = """<html lang="en"><head><title>A &amp; B</title><meta property="og:title" content="OG &quot;T&quot;"><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"x"},{"@type":"Offer"}]}</script>
<script type="application/ld+json">{broken</script><script type="application/ld+json">[{"a":1}]</script></head><body><h1>Head <b>ing</b></h1><a href="/x">1</a><a href="/y">2</a></body></html>"""


def test_page_scans(spark):
    df = spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "page_id int, html string")
    assert [(r["page_id"], r["position"], r["href"]) for r in pages.links(df).collect()] == [(1, 0, "/x"), (1, 1, "/y")]
    found = {(r["field"], r["source"]): r["value"] for r in pages.candidates(df).where("page_id = 1").collect()}
    assert found[("title", "h1")] == "Head ing" and found[("title", "html_title")] == "A & B" and found[("language", "html_lang")] == "en"
    assert [r["body"] for r in pages.json_ld(df).orderBy("script", "node").collect()] == ['{"@type":"Product","name":"x"}', '{"@type":"Offer"}', '{"a":1}']
    assert pages.open_graph(df).where("page_id = 1").first()["properties"] == {"title": 'OG "T"'}


def test_json_sitemap_csv_tables(spark):
    docs = spark.createDataFrame([(1, '{"items":[{"n":1},{"n":2}]}'), (2, '[{"n":3}]'), (3, '{"n":4}'), (4, "no json"), (5, None)], "page_id int, text string")
    assert sorted((r["page_id"], r["body"]) for r in pages.raw_json(docs).collect()) == [(1, '{"n":1}'), (1, '{"n":2}'), (2, '{"n":3}'), (3, '{"n":4}')]
    xml = spark.createDataFrame([(1, "<urlset><url><loc> http://a.example/red-shoe </loc></url><url><loc>http://a.example/red-shoe</loc></url></urlset>")], "page_id int, xml string")
    assert [(r["url"], r["title"]) for r in pages.sitemap(xml).collect()] == [("http://a.example/red-shoe", "red shoe")]
    lines = spark.createDataFrame([(0, "url,name"), (1, "http://a.example,x"), (2, '"https://b.example",y'), (3, "nothing")], "line int, text string")
    assert [r["url"] for r in pages.csv_urls(lines).orderBy("line").collect()] == ["http://a.example", "https://b.example"]
    traced = spark.createDataFrame([(1, [(["a", ""], [["1", "2"], ["", "4"]])])], "record_id int, tables array<struct<headers:array<string>,rows:array<array<string>>>>")
    assert [(r["row_index"], r["column"], r["value"]) for r in pages.table_rows(traced).collect()] == [(1, "a", "1"), (1, "column_2", "2"), (2, "column_2", "4")]


def test_whole_match_rule(spark):
    from difflib import SequenceMatcher

    from brindle.plans import catalogue

    part = {r["p_partkey"]: r for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    got = catalogue.QUERIES["match_score_whole"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == sum(r["p_brand"] == s["p_brand"] and r is not s for k, s in part.items() if k % 100 == 0 for r in part.values())
    for r in got:
        s, c = part[r["s_id"]], part[r["c_id"]]
        a, b = ({t for t in re.split("[^a-z0-9]+", x["p_name"].lower()) if len(t) > 1} for x in (s, c))
        title = max(len(a & b) / len(a | b), SequenceMatcher(None, " ".join(sorted(a)), " ".join(sorted(b))).ratio())
        same = s["p_size"] == c["p_size"] or r["s_id"] % 3 == r["c_id"] % 3 == 0 and s["p_type"] == c["p_type"]
        near = abs(s["p_retailprice"] - c["p_retailprice"]) / s["p_retailprice"] <= 0.25
        score = 0.34 * title + 0.24 + 0.25 * same + 0.05 * near + (0.12 if c["p_type"] == "PROMO" else 0.04)
        assert r["score"] == pytest.approx(score, abs=1e-4)
        assert r["label"] == ("high" if r["score"] >= 0.85 else "medium" if r["score"] >= 0.6 else "low" if r["score"] >= 0.4 else "uncertain")


def test_pairs_of_a_key_meet_in_several_tasks(spark):
    titles = [None, "", "a", "red chair", "chair red", "Red  CHAIR", "blue chair"]
    rows = [(k, i, titles[i % 7], " Acme " if i % 2 else "", None if i % 5 == 0 else str(i % 3), float(i % 4)) for k in ("x", None) for i in range(60)]
    side = lambda p: spark.createDataFrame(rows, f"k string, {p}_id int, {p}_title string, {p}_brand string, {p}_sku string, {p}_price double")
    got = matching.scored_pairs(side("s").where("s_id % 10 = 0"), side("c").coalesce(1).withColumn("c_authority", F.lit(0.04)), "k")
    assert got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
    found = {(r["s_id"], r["c_id"]): r["score"] for r in got.collect()}
    assert len(found) == got.count() == 360

    words = lambda t: {w for w in re.split("[^a-z0-9]+", t.lower()) if len(w) > 1}
    for (a, b), score in found.items():
        s, c = rows[a], rows[b]
        if s[2] is None or c[2] is None:
            continue
        x, y = words(s[2]), words(c[2])
        title = len(x & y) / len(x | y) if x and y else 0
        near = s[5] > 0 and c[5] > 0 and abs(s[5] - c[5]) / s[5] <= 0.25
        assert score == pytest.approx(0.34 * title + 0.24 * (s[3] == c[3] != "") + 0.25 * (s[4] is not None and s[4] == c[4]) + 0.05 * near + 0.04, abs=1e-4)


def each(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column(F.col("v")).alias("r")).collect()
    return {values[r["i"]]: r["r"] for r in rows}


def test_stock_codes(spark):
    given = {"AB-1": "AB-1", " x ": "x", "Draft-77": "77", "tmp__a1": "a1", "test-1234567890": None, "1234567890": "1234567890", "copy-": None, "{a}": None, "draft_[1]": None, "a1" * 11: None, "a1" * 10: "a1" * 10, "a-" * 11: "a-" * 11, "": None, None: None}
    assert each(spark, prices.sku, list(given)) == given


def test_marked_brands(spark):
    given = {"Acme™ chair": "Acme™", "® Acme chair": "®Acme", "™Acme big": "™Acme", "™": None, "a ® b ™": "a ®", "one two three four five six seven® x": None, "plain": None, " ": None, None: None}
    assert each(spark, text.marked_brand, list(given)) == given


def test_resolved_links(spark):
    base = "https://shop.example.com/en/list/page.html?sort=up#top"
    given = {"www.other.example/x": "https://www.other.example/x", "other.com": "https://other.com", "Other.CO.uk/a?b": "https://Other.CO.uk/a?b", "page.html": "https://shop.example.com/en/list/page.html", "a/b.com": "https://shop.example.com/en/list/a/b.com", "../com": "https://shop.example.com/en/com", "": ""}
    assert each(spark, lambda c: urls.absolute_url(F.lit(base), c), list(given)) == given


@pytest.mark.parametrize("column", ["loose", "first", "whole"])
def test_lenient_numbers(spark, column):
    given = {
        "1.234,5": (1234.5, 1, 0), "1,234.5": (1234.5, 1234, 0), "12,5": (12.5, 125, 0), "12,345": (12.345, 12345, 0), "7": (7.0, 7, 7), "-7.9": (7.9, -7, -7), "a 3 b 4": (34.0, 3, 0), "1e2": (12.0, 1, 100), "": (None, None, 0), "x": (None, None, 0), None: (None, None, 0),
        "9" * 25: (1e25, None, 0),
    }
    at, f = {"loose": (0, numbers.loose_float), "first": (1, numbers.first_int), "whole": (2, numbers.as_int)}[column]
    assert each(spark, f, list(given)) == {k: v[at] for k, v in given.items()}


def test_salaries(spark):
    given = {'{"currency":"USD","value":{"minValue":1,"maxValue":2,"unitText":"HOUR"}}': "USD 1 - 2 HOUR", '{"value":{"value":"5"}}': "5", '{"salaryCurrency":"EUR","value":"9"}': "EUR 9", '{"currency":"CHF"}': None, "{broken": None, None: None}
    assert each(spark, prices.salary_text, list(given)) == given


def test_dropped_equals_the_rule_read_out(spark):
    """Every combination of flags, at scores around the borders."""
    from itertools import product

    from brindle.operators import ranking

    names = ("supported", "detail_like", "utility", "detail_merchandise", "fallback_merchandise", "job")
    rows = [(score, *flags) for score in (-1, 0, 9, 10, 30) for flags in product([False, True], repeat=len(names))]
    got = spark.createDataFrame(rows, "score int, " + ", ".join(f"{n} boolean" for n in names)).withColumn("r", ranking.dropped(F.col("score"), *map(F.col, names))).collect()
    for r in got:
        reasons = [
            r["score"] < 0, r["utility"] and (r["score"] < 10 or not r["detail_like"]),
            not r["supported"] and not r["job"] and not (r["detail_merchandise"] if r["detail_like"] else r["fallback_merchandise"]), not r["supported"] and not r["detail_like"] and r["score"] < 10,
        ]
        assert r["r"] == any(reasons), r


def test_rows_without_a_key_stay(spark):
    from brindle.operators import jobs

    rows = [(None, 1, "a", None), (None, 2, "b", None), (None, 3, "a", None), ("k", 1, "", "x"), ("k", 2, "c", "y")]
    got = jobs.merged_in_order(spark.createDataFrame(rows, "k string, o int, f string, g string"), "k", ["o"], ["f", "g"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, "a", None), (None, "b", None), ("k", "c", "x")], key=repr)
