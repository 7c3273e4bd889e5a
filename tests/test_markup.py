"""Elements of markup, and microdata, cards and fragments read off them, on odd pages and against brute force."""

import json
import random
from html.parser import HTMLParser

from brindle.plans import captured
from brindle.sources import markup

PAGES = "page_id long, url string, html string, node string, item int"
SF = "/root/testdata/sf0.001"


def pages(spark, *html, url="https://shop.example/a/b"):
    return spark.createDataFrame([(i, url, h, "x", 0) for i, h in enumerate(html)], PAGES)


def shape(spark, html):
    return [(r["tag"], r["depth"], r["text"]) for r in sorted(markup.elements(pages(spark, html)).collect(), key=lambda r: r["node"])]


def test_ends_that_markup_leaves_out(spark):
    assert shape(spark, "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == [
        ("ul", 0, None), ("li", 1, None), ("#text", 2, "a"), ("li", 1, None), ("#text", 2, "b"), ("ul", 2, None), ("li", 3, None), ("#text", 4, "c"), ("li", 1, None), ("#text", 2, "d"), ("#text", 0, "e"),
    ]
    assert shape(spark, "<table><tr><td>1<td>2<tr><td>3</table>") == [
        ("table", 0, None), ("tr", 1, None), ("td", 2, None), ("#text", 3, "1"), ("td", 2, None), ("#text", 3, "2"), ("tr", 1, None), ("td", 2, None), ("#text", 3, "3"),
    ]


def test_scripts_comments_and_quotes(spark):
    assert shape(spark, '<!DOCTYPE html><!-- <b> --><script>if (a<b) x="</p>";</SCRIPT ><a title="a>b" href=\'x\'>T&amp;C</a></nothing>') == [
        ("script", 0, None), ("#text", 1, 'if (a<b) x="</p>";'), ("a", 0, None), ("#text", 1, "T&C"),
    ]
    row = markup.elements(pages(spark, '<IMG SRC="a" src=b alt hidden/><p>')).collect()
    assert {r["tag"]: r["attributes"] for r in row} == {"img": {"src": "a", "alt": "", "hidden": ""}, "p": {}}


def test_odd_pages_give_no_rows_or_text(spark):
    got = markup.elements(pages(spark, None, "", " \n", "<", "<<a <b x='", "plain & simple", "<!-- open")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {3: "<", 4: "<<a <b x='", 5: "plain & simple"}
    deep = "<div>" * 3_000 + "x" + "</div>" * 2_999
    assert markup.elements(pages(spark, deep)).where("depth = 3000 AND text = 'x'").count() == 1
    assert markup.elements(pages(spark, "x").limit(0)).count() == 0


class Plain(HTMLParser):
    """How many elements of each tag another parser sees."""

    def __init__(self):
        super().__init__()
        self.tags = []

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, dict((k, v or "") for k, v in attrs)))


def test_elements_equal_another_parser(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    got = {}
    for r in markup.elements(table).where("tag <> '#text'").orderBy("page_id", "node").collect():
        got.setdefault(r["page_id"], []).append((r["tag"], r["attributes"]))
    for page in table.collect():
        plain = Plain()
        plain.feed(page["html"])
        assert got[page["page_id"]] == plain.tags


def test_subtrees_nest(spark):
    rows = markup.elements(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    of = {(r["page_id"], r["node"]): r for r in rows}
    for r in rows:
        if r["parent"] is not None:
            above = of[r["page_id"], r["parent"]]
            assert above["node"] < r["node"] <= r["last"] <= above["last"] and above["start"] <= r["start"] <= r["end"] <= above["end"] and r["depth"] == above["depth"] + 1


def test_microdata_of_odd_items(spark):
    html = [
        '<div itemscope><span itemprop="a">1</span><span itemprop="a">2</span><span itemprop="">3</span><span itemprop="b"> </span><meta itemprop="c" content=" x "></div>',
        '<div itemscope itemtype="T"><div itemprop="p" itemscope><div itemprop="q" itemscope itemtype="Q"><time itemprop="r" datetime="2024">now</time></div></div></div><div itemscope itemtype="U"></div>',
        "<p itemprop=x>alone</p>", None, "", '<div itemscope><p itemprop="whole">a<b itemprop="part">b</b>c</p></div>',
    ]
    got = {}
    for r in markup.microdata(pages(spark, *html)).orderBy("page_id", "position").collect():
        got.setdefault(r["page_id"], []).append((r["property"], r["value"]))
    assert got == {0: [("a", "1"), ("a", "2"), ("c", "x")], 1: [("@type", "T"), ("p.q.@type", "Q"), ("p.q.r", "2024"), ("@type", "U")], 5: [("whole", "a b c"), ("part", "b")]}


def test_cards_need_company_and_a_link(spark):
    card = '<div class="b a"><a href="/{0}"><h2></h2>Link {0}</a><h3>Title {0}</h3><em>from 1.234,50 €</em><img data-src="/i{0}.png"></div>'
    two = "".join(card.format(i) for i in (1, 2))
    three = two + '<div class="a  b"><a href="/3">Three</a></div><div class="a b">no link</div><div class="other"><a href="/4">4</a></div>'
    got = markup.listing_cards(pages(spark, f"<body>{two}</body>", f"<body>{three}</body>", None)).orderBy("position").collect()
    assert [(r["page_id"], r["position"], r["url"], r["title"], r["price"], r["image"]) for r in got] == [
        (1, 0, "/1", "Link 1", "1.234,50 €", "/i1.png"), (1, 1, "/2", "Link 2", "1.234,50 €", "/i2.png"), (1, 2, "/3", "Three", None, None),
    ]


def greedy(cards, budget):
    used, out, seen = 0, [], set()
    for score, node, text in sorted(cards, key=lambda c: (-c[0], c[1])):
        size = len(text.encode())
        if text not in seen and used + size <= budget:
            out.append((node, score, size))
            used += size
            seen.add(text)
    return out


def test_fragments_equal_greedy_choice(spark):
    rng = random.Random(4)
    html = []
    for _ in range(12):
        cards = [f'<li><a href="/{rng.randrange(4)}">{"é" * rng.randrange(0, 9)}</a>{rng.choice(["", "<b>$5</b>", "<img src=x>"])}</li>' for _ in range(rng.randrange(3, 12))]
        html.append(f"<ul>{''.join(cards)}</ul>")
    table = pages(spark, *html)
    cards = markup.listing_cards(table)
    want = {}
    for c in cards.collect():
        score = 1 + 4 * (c["title"] is not None and len(c["title"]) >= 4) + 3 * (c["price"] is not None) + 2 * (c["image"] is not None)
        want.setdefault(c["page_id"], []).append((score, c["node"], html[c["page_id"]][c["start"] : c["end"]]))
    for budget in (0, 60, 150, 10_000):
        got = {}
        for r in markup.fragments_in_budget(cards, table, budget).orderBy("page_id", "place").collect():
            got.setdefault(r["page_id"], []).append((r["node"], r["score"], r["bytes"]))
        assert got == {p: g for p, own in want.items() if (g := greedy(own, budget))}


def test_card_fragments_of_the_table(spark):
    table = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = captured.card_fragments(spark, SF).collect()
    used = {}
    for r in got:
        used[r["page_id"]] = used.get(r["page_id"], 0) + r["bytes"]
    assert set(used) <= set(table) and max(used.values()) <= captured.BUDGET and json.dumps(len(used))


def test_microdata_is_read_in_one_pass_without_joins(spark, capsys):
    html = "<div itemscope itemtype=T><p itemprop=a>x <b>y</b><p itemprop=b> </p><p itemprop=c content=' '>z</div>"
    found = markup.microdata(pages(spark, html, html))
    assert sorted((r["page_id"], r["property"], r["value"]) for r in found.collect()) == [(i, *p) for i in (0, 1) for p in (("@type", "T"), ("a", "x y"), ("c", "z"))]
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Broadcast" not in plan
