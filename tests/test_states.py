"""JSON in scripts: balanced values against a scan by hand, typed scripts, state and its flattened form."""

import json
import random

from pyspark.sql import functions as F

from brindle.sources import states

PAGES = "page_id long, html string, script int, name string, body string"


def pages(spark, *html):
    return spark.createDataFrame([(i, h, 0, "x", "y") for i, h in enumerate(html)], PAGES)


def scan(text):
    """The balanced fragment, a character at a time."""
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    ends = {"{": "}", "[": "]"}[text[at]]
    depth, inside, skip = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if inside:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c == text[at]:
            depth += 1
        elif c == ends:
            depth -= 1
            if not depth:
                return text[at : i + 1]
    return None


def test_balanced_equals_scan(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices('{}[]"\\ab\n', weights=[5, 4, 2, 2, 3, 2, 2, 1, 1], k=rng.randrange(0, 40))) for _ in range(600)]
    texts += ["", "none", '{"a":"\\\\"}', "x = {" + '"k":[' * 50 + "]" * 50 + "} rest", '{"long":"' + "é\\n" * 20_000 + '"}!']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", states.balanced(F.col("t")).alias("b")).collect()
    for r in rows:
        assert r["b"] == scan(texts[r["i"]]), texts[r["i"]]


def test_embedded_json(spark):
    html = [
        '<script type=application/json>[1]</script><SCRIPT TYPE="application/LD+json">{}</SCRIPT><script type="text/x">{"a":1}</script><script type="application/json" id="__NEXT_DATA__">{"s":1}</script>',
        '<script>var data = {"a":1}, x; const data={"a":2}; mydata = {"no":1}; let product;\nfoo({"b":3})</script>', None, "", "<script>var data = {", '<script type="application/json">{"a":</script>',
    ]
    got = sorted((r["page_id"], r["script"], r["nth"], r["source"], r["body"]) for r in states.embedded_json(pages(spark, *html)).collect())
    assert got == [(0, 0, 0, "script", "[1]"), (1, 0, 0, "data", '{"a":1}'), (1, 0, 1, "data", '{"a":2}')]


def test_states_by_way_and_place(spark):
    html = [
        '<script>var __STATE__={"n":1};</script><script>globalThis.__STATE__ = {"n":2}; window.__STATE__={"n":3}</script>', '<script>window.__STATE__ = {broken}; const __STATE__ = {"n":4};</script>',
        '<script>\n__STATE__ = [5]</script><script>x.__STATE__ = [6]</script>', '<script id="__NEXT_DATA__" type="application/json"> {"n":7} </script>', '<script>window["__NUXT__"]={"n":"\\"}{"}</script>', None, "<script>window.__STATE__ =</script>",
    ]
    got = sorted((r["page_id"], r["name"], r["body"]) for r in states.page_states(pages(spark, *html)).collect())
    assert got == [(0, "__STATE__", '{"n":2}'), (1, "__STATE__", '{"n":4}'), (2, "__STATE__", "[5]"), (3, "__NEXT_DATA__", '{"n":7}'), (4, "__NUXT__", '{"n":"\\"}{"}')]


def flat(value, slots):
    """A value laid out in slots, the way pages do it."""
    at = len(slots)
    slots.append(None)
    if isinstance(value, dict):
        slots[at] = {k: flat(v, slots) for k, v in value.items()}
    elif isinstance(value, list):
        slots[at] = [flat(v, slots) for v in value]
    else:
        slots[at] = value
    return at


def test_flattened_states_come_back(spark):
    rng = random.Random(9)

    def value(deep):
        kind = rng.choice(["list", "dict", "text", "number", "none", "flag"] if deep else ["text", "number"])
        if kind == "list":
            return [value(deep - 1) for _ in range(rng.randrange(4))]
        if kind == "dict":
            return {rng.choice("abc"): value(deep - 1) for _ in range(rng.randrange(4))}
        return {"text": "t é", "number": rng.randrange(100), "none": None, "flag": True}[kind]

    for _ in range(200):
        whole, slots = {"v": value(4)}, []
        flat(whole, slots)
        assert states.revived(slots) == whole
    assert states.revived([["ShallowRef", 1], {"me": 0, "far": 99, "down": -1, "x": 2}, "y"]) == {"me": None, "far": None, "down": None, "x": "y"}
    assert states.revived([["Other", 1], "z"]) == ["Other", "z"]
    pages_ = pages(spark, f'<script id="__NUXT_DATA__">{json.dumps([{"a": 1}, "b"])}</script>', '<script id="__NUXT_DATA__">[]</script>', '<script id="__NUXT_DATA__">no</script>')
    assert sorted((r["page_id"], json.loads(r["body"])) for r in states.page_states(pages_).collect()) == [(0, {"a": "b"}), (1, [])]


def test_pushed_pieces_in_order(spark):
    html = '<script>self.__next_f.push([1,"1:{\\"a\\":1}"])</script><script>self.__next_f.push([0]);self.__next_f.push([1, "2: [2]\\n"]);self.__next_f.push([1,"3:I\\n"]);self.__next_f.push([1,"{"])</script>'
    got = states.page_states(pages(spark, html)).collect()
    assert [(r["name"], json.loads(r["body"])) for r in got] == [("__NEXT_F__", [{"a": 1}, [2]])]


def test_payloads_of_long_scripts_are_found_in_one_reading(spark):
    import time

    long = '{"a":[' + ",".join('"x{%d"' % i for i in range(20_000)) + "]}"
    rows = spark.createDataFrame([(1, f"<script>const data = {long}; var product = {{}}; let product = {{open</script>")], "page_id int, html string")
    began = time.time()
    found = sorted((r["nth"], r["source"], len(r["body"])) for r in states.embedded_json(rows).collect())
    assert found == [(0, "data", len(long)), (1, "product", 2)] and time.time() - began < 20
