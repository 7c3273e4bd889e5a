"""Markup as rows: every element with its place in the tree, and what is read off those rows: microdata, listing cards, fragments."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import urls
from brindle.functions.text import collapsed

# Elements without content, elements whose content isn't markup, and which elements an opening one ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
ENDS = {"li": ("li",), "p": ("p",), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: An element doesn't end others outside one of these.
WITHIN = frozenset("body div dl ol section table td th ul".split())
#: Attributes that give a property's value, by preference; href and src are addresses.
VALUES = ("content", "href", "src", "datetime")
#: Elements that can be a card of a listing.
CARDS = ("a", "article", "div", "li", "section", "td", "tr")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s<>/\"']*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SCOPE = pa.struct([("node", pa.int32()), ("property", pa.string())])
_NODE = pa.struct(
    [
        ("node", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())),
        ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("scopes", pa.list_(_SCOPE)),
    ]
)
_DDL = "node int, parent int, last int, depth int, tag string, attributes map<string,string>, text string, start long, end long, scopes array<struct<node:int,property:string>>"


def _nodes(html: str) -> list[dict]:
    """The elements and texts of one document, in order. An element ends with its end tag, at one that ``ENDS`` it, or with its parent."""
    out: list[dict] = []
    open_: list[dict] = []

    def put(tag: str, attributes: dict[str, str | None], text: str | None, start: int, end: int) -> dict:
        above = open_[-1] if open_ else None
        scopes = above["scopes"] + ([{"node": above["node"], "property": above["attributes"].get("itemprop")}] if "itemscope" in above["attributes"] else []) if above else []
        made = {"node": len(out), "parent": above and above["node"], "last": len(out), "depth": len(open_), "tag": tag, "attributes": attributes, "text": text, "start": start, "end": end, "scopes": scopes}
        out.append(made)
        return made

    def close(to: int, at: int) -> None:
        for made in open_[to:]:
            made["last"], made["end"] = len(out) - 1, at
        del open_[to:]

    def words(text: str, start: int, end: int) -> None:
        if text := " ".join(text.split()):
            put("#text", {}, text, start, end)

    at = 0
    while at < len(html):
        m = _TAG.search(html, at)
        words(unescape(html[at : m.start() if m else len(html)]), at, m.start() if m else len(html))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            found = next((i for i in range(len(open_) - 1, -1, -1) if open_[i]["tag"] == tag), None)
            if found is not None:
                close(found, at)
            continue
        for i in range(len(open_) - 1, -1, -1) if tag in ENDS else ():
            if open_[i]["tag"] in ENDS[tag]:
                close(i, m.start())
            elif open_[i]["tag"] in WITHIN:
                break
        attributes: dict[str, str] = {}
        for name, value in _ATTRIBUTE.findall(m[3]):
            attributes.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" else value))
        made = put(tag, attributes, None, m.start(), at)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>|\Z", re.IGNORECASE).search(html, at)
            open_.append(made)
            words(html[at : end.start()] if tag in ("script", "style") else unescape(html[at : end.start()]), at, end.start())
            at = end.end()
            close(len(open_) - 1, at)
        elif tag not in VOID and not m[3].endswith("/"):
            open_.append(made)
    close(0, len(html))
    return out


def elements(pages: DataFrame, key: str = "page_id", html: str = "html", beside: Sequence[str] = (), told: str | None = None) -> DataFrame:
    """(key, node, parent, last, depth, tag, attributes, text, start, end, scopes) of every element and text of the documents.

    Nodes count from 0 in document order, and those of an element's subtree are node to last. A text
    is a node of tag #text with white space collapsed and entities resolved; blank ones and comments are left out. start
    and end are places in the document. ``scopes`` are the item scopes around the node, outermost first, each with its own
    property name. A row of ``pages`` is one document and nothing is shuffled; null and empty ones give no rows. The columns
    ``beside`` of a page stand beside each of its nodes. With ``told``, a last column of that name has all texts of the subtree of each
    element with itemprop, by one space; null where there are none, and for other nodes.
    """
    rows = pages.select(key, F.col(html).cast("string").alias(html), *beside)
    of_page = [key, *beside]

    def subtree(nodes: list[dict], made: dict) -> str | None:
        if "itemprop" in made["attributes"]:
            return " ".join(x["text"] for x in nodes[made["node"] : made["last"] + 1] if x["tag"] == "#text") or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, part, texts = [], [], []

            def made() -> pa.RecordBatch:
                beside_them = [batch.column(c).take(pa.array(page, pa.int32())) for c in of_page]
                columns = [pa.array([x[f.name] for x in part], f.type) for f in _NODE]
                found = pa.RecordBatch.from_arrays([*beside_them, *columns, *([pa.array(texts, pa.string())] if told else [])], [*of_page, *_NODE.names, *([told] if told else [])])
                page.clear(), part.clear(), texts.clear()
                return found

            for i, text in enumerate(batch.column(1)):
                nodes = _nodes(text.as_py() or "")
                for x in nodes:
                    page.append(i)
                    part.append(x | {"attributes": list(x["attributes"].items())})
                    if told:
                        texts.append(subtree(nodes, x))
                    if len(part) == 8_192:
                        yield made()
            if part:
                yield made()

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in of_page)
    return rows.mapInArrow(run, f"{types}, {_DDL}" + (f", `{told}` string" if told else ""))


def microdata(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, item, property, position, value) of the items of each page that no other item holds; item is their node.

    A property of an item within an item has a dotted name, and @type is an item's own type. Its value is the first
    of content, href, src and datetime that isn't empty, addresses resolved against the page's, or else the element's text.
    Repeated properties have several rows; empty values and names, and items within an item that are no property of it,
    give none. Positions are nodes, so they keep the order.
    """
    known = url in pages.columns
    located = pages.select(key, html, (F.col(url) if known else F.lit(None)).cast("string").alias("_url"))
    nodes = elements(located, key, html, ["_url"], "_told")
    attribute = lambda name: F.trim(F.col("attributes")[name])
    scope, prop = F.map_contains_key("attributes", F.lit("itemscope")), F.nullif(attribute("itemprop"), F.lit(""))
    names = F.transform(F.slice("scopes", F.lit(2), F.greatest(F.size("scopes") - 1, F.lit(0))), lambda s: F.nullif(F.trim(s["property"]), F.lit("")))
    whole = ~F.exists(names, lambda n: n.isNull())
    marked = nodes.where(whole & (scope | (prop.isNotNull() & (F.size("scopes") > 0))))
    marked = marked.select(
        key, "node", "last", scope.alias("scope"), prop.alias("prop"), F.coalesce(F.get("scopes", 0)["node"], F.col("node")).alias("item"), F.array_join(names, ".").alias("path"),
        F.size("scopes").alias("deep"), attribute("itemtype").alias("type"), "_told",
        F.coalesce(*(F.nullif(urls.absolute_url(F.col("_url"), F.col("attributes")[a]) if a in ("href", "src") else attribute(a), F.lit("")) for a in VALUES)).alias("given"),
    )
    dotted = lambda *parts: F.concat_ws(".", *(F.nullif(p, F.lit("")) for p in parts))
    own_type = F.when(F.col("deep") > 0, F.col("prop")).otherwise(F.lit(""))
    typed = F.col("scope") & (F.col("type") != "") & ((F.col("deep") == 0) | F.col("prop").isNotNull())
    name, value = F.when(F.col("scope"), own_type).otherwise(F.col("prop")), F.when(F.col("scope"), F.col("type")).otherwise(F.coalesce("given", "_told"))
    found = marked.where(typed | (~F.col("scope") & F.col("prop").isNotNull() & F.coalesce("given", "_told").isNotNull()))
    return found.select(key, "item", dotted(F.col("path"), name, F.when(F.col("scope"), "@type")).alias("property"), F.col("node").alias("position"), value.alias("value"))


def listing_cards(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = 3) -> DataFrame:
    """(key, parent, tag, shape, position, node, start, end, url, title, price, image) of the cards of every listing in the pages.

    A listing is what an element repeats: ``least`` children or more of one tag and class, each with a link. A card's url
    is its first link, its title the first heading's text or else the link's, its price the first amount with a currency, its image
    the first picture. Cards count from 0 in a listing. Cards without a link aren't cards; empty fields are null.
    """
    nodes = elements(pages, key, html)
    shape = F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.split(F.trim(F.col("attributes")["class"]), r"\s+"))), " "), F.lit(""))
    group = [key, "parent", "tag", "shape"]
    shaped = nodes.where(F.col("tag").isin(*CARDS)).select(key, "parent", "tag", shape.alias("shape"), "node", "last", "start", "end")
    alike = shaped.groupBy(*group).agg(F.collect_list(F.struct("node", "last", "start", "end")).alias("own")).where(F.size("own") >= least)
    cards = alike.select(*group, F.explode("own").alias("c")).select(*group, "c.*")
    href, src = F.col("attributes")["href"], F.coalesce(F.col("attributes")["src"], F.col("attributes")["data-src"])
    parts = nodes.where(F.col("tag").isin("a", "img", "#text", "h1", "h2", "h3", "h4", "h5", "h6")).select(
        key, F.col("node").alias("at"), F.col("last").alias("to"), F.col("tag").alias("what"), F.nullif(F.trim(href), F.lit("")).alias("href"), F.nullif(F.trim(src), F.lit("")).alias("src"), "text"
    )
    held = cards.join(parts, key).where("at BETWEEN node AND last")
    first = lambda value, when: F.min_by(value, F.when(when, F.col("at")))
    money = F.regexp_extract("text", r"(?:[$€£¥₹]\s?\d[\d.,]*|\d[\d.,]*\s?(?:[$€£¥₹]|EUR|USD|GBP)\b?)", 0)
    one = held.groupBy(*group, "node", "start", "end").agg(
        first("href", F.col("href").isNotNull()).alias("url"), first("src", (F.col("what") == "img") & F.col("src").isNotNull()).alias("image"),
        first(F.trim(money), F.col("text").isNotNull() & (money != "")).alias("price"),
        F.min(F.when(F.col("what").rlike("^h[1-6]$"), F.struct("at", "to"))).alias("heading"), F.min(F.when(F.col("href").isNotNull(), F.struct("at", "to"))).alias("link"),
        F.array_sort(F.collect_list(F.when(F.col("what") == "#text", F.struct("at", "text")))).alias("texts"),
    )
    # a heading without text of its own says nothing
    of = lambda span: F.nullif(F.array_join(F.transform(F.filter("texts", lambda t: t["at"].between(span["at"], span["to"])), lambda t: t["text"]), " "), F.lit(""))
    linked = one.where("url IS NOT NULL").withColumn("title", F.coalesce(of(F.col("heading")), of(F.col("link"))))
    listed = linked.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("node", "start", "end", "url", "title", "price", "image"))).alias("own")).where(F.size("own") >= least)
    return listed.select(*group, F.posexplode("own").alias("position", "c")).select(*group, "position", "c.*")


def card_score(title: Column, price: Column, image: Column) -> Column:
    """How much a card says: 1 for its link, 4 for a title of 4 letters or more, 3 for a price, 2 for a picture."""
    has = lambda c, n: F.when(c, n).otherwise(0)
    return F.lit(1) + has(F.length(collapsed(title)) >= 4, 4) + has(price.isNotNull(), 3) + has(image.isNotNull(), 2)


def fragments_in_budget(cards: DataFrame, pages: DataFrame, budget: int, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, place, node, score, bytes) of the cards whose markup fits ``budget`` bytes a page, taken best score first, then in order.

    A card that no longer fits is passed over and later ones may still fit; markup that was taken isn't taken again.
    A budget of 0 or less takes none.
    """
    marked = cards.select(key, "node", "start", "end", card_score(F.col("title"), F.col("price"), F.col("image")).alias("score"))
    sized = marked.join(pages.select(key, F.col(html).alias("_html")), key)
    markup = F.trim(F.substring(F.col("_html"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    sized = sized.select(key, "node", "score", F.octet_length(markup).cast("long").alias("bytes"), F.sha2(markup, 256).alias("markup")).where("bytes > 0")
    once = sized.groupBy(key, "markup").agg(F.min(F.struct((-F.col("score")).alias("less"), "node", "bytes")).alias("c"))
    ordered = F.array_sort(F.collect_list("c"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<less:int,node:int,bytes:bigint>>").alias("taken"))
    step = lambda acc, c: F.when(acc["used"] + c["bytes"] <= budget, F.struct((acc["used"] + c["bytes"]).alias("used"), F.array_append(acc["taken"], c).alias("taken"))).otherwise(acc)
    taken = once.groupBy(key).agg(F.aggregate(ordered, start, step, lambda acc: acc["taken"]).alias("taken"))
    return taken.select(key, F.posexplode("taken").alias("place", "c")).select(key, "place", "c.node", (-F.col("c.less")).alias("score"), "c.bytes")
