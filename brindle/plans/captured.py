"""Queries over what captured pages hold: their elements, cards, microdata, scripts and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import candidates as json_values
from brindle.operators import variants
from brindle.plans.registry import query, table
from brindle.session import spread
from brindle.sources import markup, states

#: Bytes of markup that a page's best cards may have together.
BUDGET = 150
ALIASES = {"name": "title", "price": "price", "price_currency": "currency", "sku": "sku", "item_size": "size", "kind": "type", "images": "additional_images", "rating_value": "rating"}


@query("markup_elements", """SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)(<script>).*?</script>|<!--.*?-->', '\\1', 'g'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY page_id, tag""")
def markup_elements(spark, sf_dir) -> DataFrame:
    """How many elements of each tag a page has; what looks like a tag inside a script isn't one."""
    return markup.elements(table(spark, sf_dir, "pages")).where("tag <> '#text'").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("page_cards", """SELECT page_id, CAST(i - 1 AS INTEGER) AS position, regexp_extract(l[i], 'href="([^"]*)"', 1) AS url, replace(regexp_extract(l[i], '>([^<>]*)</a>', 1), '&amp;', '&') AS title
 FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS l FROM pages), generate_series(1, len(l)) g(i) WHERE len(l) >= 3""")
def page_cards(spark, sf_dir) -> DataFrame:
    """The cards of the listings on captured pages."""
    return markup.listing_cards(table(spark, sf_dir, "pages")).select("page_id", "position", "url", "title")


@query("card_fragments")
def card_fragments(spark, sf_dir) -> DataFrame:
    """The best cards of each page within a budget of bytes, passing over those that don't fit: a fold SQL hasn't; tested by brute force."""
    pages = table(spark, sf_dir, "pages")
    return markup.fragments_in_budget(markup.listing_cards(pages), pages, BUDGET)


def _text(column: str) -> Column:
    return F.col(column).cast("string")


@query("microdata_properties", """SELECT p_partkey, u.p AS property, u.v AS value FROM (SELECT p_partkey, unnest([{'p': '@type', 'v': 'https://schema.org/Product'}, {'p': 'name', 'v': p_name || ' & more'}, {'p': 'url', 'v': 'https://shop.example/p/' || p_partkey},
 {'p': 'brand.@type', 'v': 'Brand'}, {'p': 'brand.name', 'v': p_brand}, {'p': 'size', 'v': CAST(p_size AS VARCHAR)}, {'p': 'size', 'v': CASE WHEN p_partkey % 2 = 0 THEN 'size of ' || p_type ELSE '' END}]) AS u FROM part) WHERE u.v <> ''""")
def microdata_properties(spark, sf_dir) -> DataFrame:
    """Items and the items they hold, properties by attribute and by text, one that no item holds and an item that is no property."""
    html = F.concat(
        F.lit('<i itemprop="lost">no item</i><main><div itemscope itemtype="https://schema.org/Product"><h1 itemprop=name>'), F.col("p_name"), F.lit(" &amp; <b>more</b></h1><a itemprop='url' href='/p/"), _text("p_partkey"),
        F.lit("'>to</a><section itemprop=\"brand\" itemscope itemtype=Brand><span itemprop=name>"), F.col("p_brand"), F.lit('</span></section><meta itemprop="size" content="'), _text("p_size"), F.lit('"/><p itemprop="size">'),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("size of <i>"), F.col("p_type"), F.lit("</i>"))).otherwise(""), F.lit("<p>after<div itemscope><i itemprop=lost>no property</i></div></div></main>"),
    )
    pages = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", html.alias("html"), F.lit("https://shop.example/list?q=1").alias("url"))
    return markup.microdata(pages, "p_partkey").select("p_partkey", "property", "value")


@query("embedded_payloads", """SELECT p_partkey, 'script' AS source, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part UNION ALL
 SELECT p_partkey, 'productData', p_name || ' }" ]{', CAST(p_size + 1 AS VARCHAR) FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, 'pageData', p_brand, NULL FROM part""")
def embedded_payloads(spark, sf_dir) -> DataFrame:
    """JSON in typed scripts and assignments; brackets and quotes inside strings, broken and unbalanced values beside."""
    item = lambda name, size: F.to_json(F.struct(name.alias("name"), size.alias("size")))
    odd = item(F.concat(F.col("p_name"), F.lit(' }" ]{')), F.col("p_size") + 1)
    html = F.concat(
        F.lit('<script type="application/json" data-x>'), item(F.col("p_name"), F.col("p_size")), F.lit('</script><script type="application/json">{broken</script><script>track("{"); let product = {never; const productData='),
        F.when(F.col("p_partkey") % 3 > 0, odd).otherwise("{open: ["), F.lit("</script><script>var pageData = "), F.to_json(F.struct(F.col("p_brand").alias("name"), F.array(F.lit("]")).alias("list"))), F.lit(";other = {}</script>"),
    )
    found = states.embedded_json(spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", html.alias("html")), "p_partkey")
    return found.select("p_partkey", "source", F.get_json_object("body", "$.name").alias("name"), F.get_json_object("body", "$.size").alias("size"))


@query("page_state_values", """SELECT p_partkey, '__INITIAL_STATE__' AS name, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS title FROM part UNION ALL
 SELECT p_partkey, '__NUXT_DATA__', p_name FROM part UNION ALL SELECT p_partkey, '__NEXT_F__', p_type FROM part WHERE p_partkey % 3 = 0""")
def page_state_values(spark, sf_dir) -> DataFrame:
    """State assigned to a window or declared, flattened into slots, or pushed in pieces; of two assignments the window's counts."""
    json_of = lambda c: F.to_json(F.struct(c.alias("title")))
    window = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("window['__INITIAL_STATE__'] = "), json_of(F.col("p_name")), F.lit(";"))).otherwise("")
    pushed = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('self.__next_f.push([1,"7:{\\"title\\":\\"'), F.col("p_type"), F.lit('\\"}"])'))).otherwise('self.__next_f.push([1,"text"])')
    html = F.concat(
        F.lit("<script>var __INITIAL_STATE__ = "), json_of(F.col("p_brand")), F.lit("</script><script>a();"), window, F.lit('</script><script id="__NUXT_DATA__" type="application/json">[["Reactive",1],{"title":2,"self":1},"'),
        F.col("p_name"), F.lit('"]</script><script>'), pushed, F.lit("</script>"),
    )
    found = states.page_states(spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", html.alias("html")), "p_partkey")
    return found.select("p_partkey", "name", F.coalesce(F.get_json_object("body", "$.title"), F.get_json_object("body", "$[0].title")).alias("title"))


@query("event_values", "SELECT event_id, 'size' AS field, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def event_values(spark, sf_dir) -> DataFrame:
    """The known keys of the events' own JSON."""
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return json_values.candidates(rows, "event_id", "v", {"k": "size"}, depth=2)


@query("json_candidates", """SELECT p_partkey, u.f AS field, u.p AS path, u.v AS value FROM (SELECT p_partkey, unnest([{'f': 'title', 'p': 'name', 'v': p_name}, {'f': 'brand', 'p': 'brand/name', 'v': p_brand}, {'f': 'price', 'p': 'offers/0/price', 'v': CAST(p_size AS VARCHAR)},
 {'f': 'currency', 'p': 'offers/0/priceCurrency', 'v': 'EUR'}, {'f': 'category', 'p': 'crumbs/category', 'v': 'Home > ' || p_type}, {'f': 'size', 'p': 'additionalProperty/0/value', 'v': CAST(p_size AS VARCHAR)},
 {'f': 'type', 'p': 'specs/0/FieldValues/1', 'v': p_type}, {'f': 'type', 'p': 'specs/0/FieldValues/0', 'v': 'new'}, {'f': 'rating', 'p': 'review/ratingValue', 'v': '4'}]) AS u FROM part)""")
def json_candidates(spark, sf_dir) -> DataFrame:
    """A product of nested JSON: a brand, offers, breadcrumbs, labelled properties; its variants and its review's title aren't candidates."""
    s, lit = F.struct, lambda x, name: F.lit(x).alias(name)
    named = lambda c, name="name": c.alias(name)
    body = F.to_json(
        s(
            lit("Product", "@type"), named(F.col("p_name")), s(lit("http://schema.org/Brand", "@type"), named(F.col("p_brand"))).alias("brand"), F.array(s(named(F.col("p_size"), "price"), lit("EUR", "priceCurrency"))).alias("offers"),
            s(lit("BreadcrumbList", "@type"), F.array(s(lit("Home", "name"), F.lit(1).alias("position")), s(named(F.col("p_type")), F.lit(2).alias("position"))).alias("itemListElement")).alias("crumbs"),
            F.array(s(lit("Item size", "name"), named(F.col("p_size"), "value"))).alias("additionalProperty"), F.array(s(lit("kind", "FieldName"), F.array(F.lit("new"), F.col("p_type")).alias("FieldValues"))).alias("specs"),
            F.array(s(lit("v1", "sku"), named(F.col("p_size"), "price"))).alias("variants"), s(lit("Review", "@type"), lit("Good", "name"), F.lit(4).alias("ratingValue")).alias("review"), lit("  ", "sku"),
        )
    )
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.try_parse_json(body).alias("v"))
    return json_values.candidates(rows, "p_partkey", "v", ALIASES)


@query("payload_best_fields", """WITH p AS (SELECT p_partkey, 0 AS position, 22 AS priority, p_name AS title, CAST(p_size AS VARCHAR) AS price, p_brand AS brand, CAST(NULL AS VARCHAR) AS sku FROM part WHERE p_partkey % 4 <> 3
 UNION ALL SELECT p_partkey, 1, 58, 'api ' || p_name, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size + 1 AS VARCHAR) END, NULL, 'S' || p_partkey FROM part),
 e AS (UNPIVOT p ON title, price, brand, sku INTO NAME field VALUE value) SELECT p_partkey, field, arg_max(value, priority) AS value, CAST(arg_max(position, priority) AS INTEGER) AS position FROM e GROUP BY p_partkey, field""")
def payload_best_fields(spark, sf_dir) -> DataFrame:
    """Payloads a page has loaded: one of unknown kind, one of a product API and two that no spec reads; each field from the best."""
    s = F.struct
    generic = F.to_json(s(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 != 3, F.col("p_size")).alias("price"), s(F.col("p_brand").alias("name")).alias("brand")))
    api = F.to_json(s(s(F.concat(F.lit("api "), "p_name").alias("title"), s(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 1).alias("current")).alias("price"), F.concat(F.lit("S"), _text("p_partkey")).alias("sku")).alias("product")))
    payload = lambda at, kind, family, url, body: s(F.lit(at).alias("position"), F.lit(kind).alias("kind"), F.lit(family).alias("family"), F.lit(url).alias("url"), body.alias("body"))
    each = F.explode(
        F.array(payload(0, "generic_json", "", "https://x.example/a", generic), payload(1, "product_api", "Shopify", "https://x.example/products/1.js", api), payload(2, "graphql", "", "", F.lit("{broken")), payload(3, "graphql", "", "", F.lit('{"name":"no price"}')))
    )
    payloads = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", each.alias("p")).select("p_partkey", "p.*")
    return json_values.best_fields(json_values.payload_fields(payloads, "p_partkey"), "p_partkey")


def _variants(spark, sf_dir) -> DataFrame:
    """Line items as variants of their parts: some with both options, one, or none; skus that go on a shorter one."""
    q = F.col("l_linenumber")
    size, color = F.when(q % 4 != 3, (F.col("l_quantity") % 3).cast("int").cast("string")), F.when(q % 4 != 2, F.col("l_returnflag"))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product"), (F.col("l_orderkey") * 10 + q).alias("variant"), F.create_map(F.lit("size"), F.when(q != 7, size), F.lit("color"), F.when(q != 7, color)).alias("options"),
        F.when(q % 2 == 0, F.concat(F.lit("S"), (F.col("l_suppkey") % 4).cast("string"))).when(q == 1, F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string"), F.lit("-"), size)).alias("sku"),
        *(none.alias(c) for c in ("availability", "currency", "image_url", "price", "stock", "title", "url")), *(none.alias(f"parent_{c}") for c in ("title", "price", "currency")), F.lit("N").alias("parent_color"),
    )


_VARIANTS = """v AS (SELECT l_partkey AS product, l_orderkey * 10 + l_linenumber AS variant, CASE WHEN l_linenumber <> 7 AND l_linenumber % 4 <> 3 THEN CAST(CAST(l_quantity AS BIGINT) % 3 AS VARCHAR) END AS size, CASE WHEN l_linenumber <> 7 AND l_linenumber % 4 <> 2 THEN l_returnflag END AS color,
 CASE WHEN l_linenumber % 2 = 0 THEN 's' || l_suppkey % 4 WHEN l_linenumber = 1 THEN 's' || l_suppkey % 4 || '-' || CAST(l_quantity AS BIGINT) % 3 END AS sku FROM lineitem)"""


@query("variants_undominated", f"""WITH {_VARIANTS}, g AS (SELECT product, size, count(color) AS colored FROM v WHERE size IS NOT NULL GROUP BY 1, 2), h AS (SELECT product, color, count(size) AS sized FROM v WHERE color IS NOT NULL GROUP BY 1, 2)
 SELECT v.product, v.variant FROM v LEFT JOIN g ON g.product = v.product AND g.size = v.size LEFT JOIN h ON h.product = v.product AND h.color = v.color
 WHERE (v.size IS NULL AND v.color IS NULL) OR (v.size IS NOT NULL AND v.color IS NOT NULL) OR (v.color IS NULL AND colored = 0) OR (v.size IS NULL AND sized = 0)""")
def variants_undominated(spark, sf_dir) -> DataFrame:
    """Variants whose options no other variant of the part has and more."""
    return variants.without_dominated(_variants(spark, sf_dir)).select("product", "variant")


@query("variants_of_options", f"""WITH {_VARIANTS}, s AS (SELECT product, count(DISTINCT coalesce(size, '-') || '|' || coalesce(color, '-')) FILTER (size IS NOT NULL OR color IS NOT NULL) AS kinds FROM v GROUP BY product),
 a AS (SELECT v.* FROM v JOIN s USING (product) WHERE size IS NOT NULL OR color IS NOT NULL OR kinds = 0 OR (kinds = 1 AND sku IS NOT NULL)),
 c AS (SELECT product, count(size) AS sized, count(*) FILTER (size IS NOT NULL AND color IS NOT NULL) AS paired, count(*) FILTER (size IS NULL AND color <> 'N') AS unlike FROM a GROUP BY product)
 SELECT product, variant FROM a JOIN c USING (product) WHERE NOT (color IS NOT NULL AND size IS NULL AND paired = 0 AND sized >= 2 AND unlike = 0)""")
def variants_of_options(spark, sf_dir) -> DataFrame:
    """Variants without options beside others with, and colours beside sizes, go."""
    return variants.without_colour_only(variants.without_axisless(_variants(spark, sf_dir))).select("product", "variant")


@query("variant_sku_aliases", f"""WITH {_VARIANTS}, r AS (SELECT *, (size IS NOT NULL)::INT + (color IS NOT NULL)::INT + 1 AS rich FROM v WHERE sku IS NOT NULL)
 SELECT product, variant FROM v WHERE NOT EXISTS (SELECT 1 FROM r p JOIN r c ON c.product = p.product AND c.sku = p.sku || '-' || p.size AND c.rich >= p.rich WHERE p.product = v.product AND p.variant = v.variant)""")
def variant_sku_aliases(spark, sf_dir) -> DataFrame:
    """Variants whose sku is the parent's of another that has their size go."""
    return variants.without_parent_skus(_variants(spark, sf_dir)).select("product", "variant")
