"""Queries over products and documents: parts, line items and documents stand in for extracted records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import prices, text
from brindle.operators import matching, records
from brindle.plans.registry import query, table


def _tok(x: str, least: int = 2) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: length(t) >= {least})"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct({a} || {b})) END"


_PRICE_TEXTS = "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '$' || printf('%.2f', p_retailprice) WHEN 1 THEN replace(printf('%.2f', p_retailprice), '.', ',') || ' €' WHEN 2 THEN '1.' || (100 + p_partkey % 900) || ',50 €' WHEN 3 THEN '1,' || (100 + p_partkey % 900) || '.25' WHEN 4 THEN CAST(p_partkey % 1000 AS VARCHAR) WHEN 5 THEN 'price ' || (p_partkey % 1000) WHEN 6 THEN '-$' || (p_partkey % 1000) ELSE '€' || (10 + p_partkey % 80) || '.000' END AS raw FROM part"


def _price_texts(spark, sf_dir) -> DataFrame:
    key, two, three = F.col("p_partkey"), F.format_string("%.2f", "p_retailprice"), (100 + F.col("p_partkey") % 900).cast("string")
    small = (key % 1000).cast("string")
    forms = [F.concat(F.lit("$"), two), F.concat(F.replace(two, F.lit("."), F.lit(",")), F.lit(" €")), F.concat(F.lit("1."), three, F.lit(",50 €")), F.concat(F.lit("1,"), three, F.lit(".25")), small, F.concat(F.lit("price "), small), F.concat(F.lit("-$"), small), F.concat(F.lit("€"), (10 + key % 80).cast("string"), F.lit(".000"))]
    raw = forms[7]
    for i in range(6, -1, -1):
        raw = F.when(key % 8 == i, forms[i]).otherwise(raw)
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


@query("price_normalize", f"""SELECT p_partkey, raw, CASE WHEN starts_with(raw, '-') THEN NULL WHEN length(regexp_replace(num, '[^0-9]', '', 'g')) <= 3 AND NOT contains(num, '.') AND NOT regexp_matches(raw, '[$€]|price') THEN NULL ELSE num END AS price,
 CASE WHEN contains(raw, '$') THEN 'USD' WHEN contains(raw, '€') THEN 'EUR' END AS currency FROM (SELECT *, CASE WHEN contains(n, ',') AND contains(n, '.') THEN CASE WHEN strpos(n, ',') > strpos(n, '.') THEN replace(replace(n, '.', ''), ',', '.') ELSE replace(n, ',', '') END
 WHEN regexp_matches(n, ',[0-9]{{1,2}}$') THEN replace(n, ',', '.') WHEN regexp_matches(n, '^[0-9]+(\\.[0-9]{{3}})+$') THEN replace(n, '.', '') ELSE n END AS num FROM (SELECT *, regexp_extract(raw, '[0-9][0-9.,]*') AS n FROM ({_PRICE_TEXTS})))""")
def price_normalize(spark, sf_dir) -> DataFrame:
    return _price_texts(spark, sf_dir).select("p_partkey", "raw", prices.decimal_price(F.col("raw")).alias("price"), prices.currency_of(F.col("raw")).alias("currency"))


@query("price_range_struct", """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS DOUBLE) END AS price_min, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size + 10 AS DOUBLE) END AS price_max FROM part""")
def price_range_struct(spark, sf_dir) -> DataFrame:
    low, high = F.col("p_size").cast("string"), (F.col("p_size") + 10).cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("$"), low, F.lit(" - $"), high)).when(F.col("p_partkey") % 3 == 1, F.concat(low, F.lit(" to "), high)).otherwise(low)
    found = prices.price_range(raw)
    return table(spark, sf_dir, "part").select("p_partkey", found["price_min"].alias("price_min"), found["price_max"].alias("price_max"))


@query("availability_normalize", """SELECT state, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'in_stock' WHEN 'view' THEN 'out_of_stock' WHEN 'signup' THEN 'preorder' WHEN 'purchase' THEN 'limited_stock' ELSE 'ask us' END AS state FROM events) GROUP BY state""")
def availability_normalize(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    raw = F.when(kind == "click", "https://schema.org/InStock").when(kind == "view", "Currently unavailable").when(kind == "signup", "PRE-ORDER now").when(kind == "purchase", "limited_stock").otherwise("ask us")
    return table(spark, sf_dir, "events").groupBy(prices.availability(raw).alias("state")).agg(F.count("*").alias("n"))


@query("backfill_left_lookup", """SELECT l_returnflag, count(*) AS n, count(price) AS filled, round(sum(price), 2) AS total FROM (SELECT l_returnflag, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END, i.p_retailprice, t.price) AS price FROM lineitem
 LEFT JOIN (SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 2 = 0) i ON l_partkey = i.p_partkey LEFT JOIN (SELECT lower(p_brand) AS k, arg_max(p_retailprice, p_partkey) AS price FROM part GROUP BY 1) t ON lower('BRAND#' || (l_partkey % 40)) = t.k) GROUP BY l_returnflag""")
def backfill_left_lookup(spark, sf_dir) -> DataFrame:
    """Null prices of line items from parts by key, else by brand: two left joins to side tables deduplicated first."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", F.concat(F.lit("BRAND#"), F.col("l_partkey") % 40).alias("brand"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).alias("price"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("ord"))
    done = matching.filled(rows, part.where("p_partkey % 2 = 0").withColumn("key", F.col("p_partkey")), part.withColumn("key", F.lower("p_brand")), "l_partkey", "brand", ["price"])
    return done.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("price").alias("filled"), F.round(F.sum("price"), 2).alias("total"))


_PAIR = f"""SELECT s.p_brand, s.p_partkey AS s_id, c.p_partkey AS c_id, round(least(1, greatest(0, 0.34 * ({_jaccard(_tok('s.p_name'), _tok('c.p_name'))}) + 0.24 + CASE WHEN s.p_size = c.p_size THEN 0.25 ELSE 0 END + CASE WHEN s.p_retailprice > 0 AND c.p_retailprice > 0 AND abs(s.p_retailprice - c.p_retailprice) / s.p_retailprice <= 0.25 THEN 0.05 ELSE 0 END + CASE WHEN c.p_type = 'PROMO' THEN 0.12 ELSE 0.04 END)), 4) AS score
 FROM part s JOIN part c ON s.p_brand = c.p_brand AND s.p_partkey % 100 = 0 AND c.p_partkey <> s.p_partkey"""


@query("match_score", f"SELECT p_brand, s_id, c_id, score, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.6 THEN 'medium' WHEN score >= 0.4 THEN 'low' ELSE 'uncertain' END AS label FROM ({_PAIR})")
def match_score(spark, sf_dir) -> DataFrame:
    """The query set, parts whose key is divisible by 100, against all other parts of their brand; titles by shared tokens."""
    return _matched(spark, sf_dir, False)


@query("match_score_whole")
def match_score_whole(spark, sf_dir) -> DataFrame:
    """As match_score, with the whole rule for titles and identifiers; tested against brute force, for SQL has no matching blocks."""
    return _matched(spark, sf_dir, True)


def _matched(spark, sf_dir, whole: bool) -> DataFrame:
    part = table(spark, sf_dir, "part")
    side = lambda p: [F.col("p_partkey").alias(f"{p}_id"), F.col("p_name").alias(f"{p}_title"), F.col("p_brand").alias(f"{p}_brand"), F.col("p_size").cast("string").alias(f"{p}_sku"), F.col("p_retailprice").alias(f"{p}_price")]
    more = lambda p: [F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias(f"{p}_gtin"), F.lit(" ").alias(f"{p}_mpn")] if whole else []
    source = part.where("p_partkey % 100 = 0").select("p_brand", *side("s"), *more("s"))
    candidates = part.select("p_brand", *side("c"), *more("c"), F.when(F.col("p_type") == "PROMO", 0.12).otherwise(0.04).alias("c_authority"))
    return matching.scored_pairs(source, candidates, "p_brand", whole).where("s_id <> c_id")


_TAX = "SELECT DISTINCT lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS category FROM part"


@query("taxonomy_match", f"""SELECT product_id, category, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, length(category), category) AS rank FROM (
 SELECT p_partkey AS product_id, category, len(list_intersect(list_distinct({_tok("p_name || ' ' || p_type")}), list_distinct({_tok('category')}))) / len(list_distinct({_tok('category')})) AS score FROM part, ({_TAX})) WHERE score >= 0.42) WHERE rank <= 5""")
def taxonomy_match(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    taxonomy = part.select(F.concat(F.lower("p_type"), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("category")).distinct()
    return matching.taxonomy_match(part.select(F.col("p_partkey").alias("product_id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), taxonomy)


_WORDS = _tok("p_name || ' ' || p_type", 3)
_PAIRS = f"list_transform(generate_series(1, len({_WORDS}) - 1), lambda i: ({_WORDS})[i] || ' ' || ({_WORDS})[i + 1])"
_KEYWORDS = f"array_to_string(list_filter({_WORDS} || {_PAIRS}, lambda x, i: list_position({_WORDS} || {_PAIRS}, x) = i), '|')"


@query("enrich_part", f"""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])red([^a-z0-9]|$)') THEN 'red' WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])blue([^a-z0-9]|$)') THEN 'blue' WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])green([^a-z0-9]|$)') THEN 'green' END AS color,
 CASE WHEN p_size < 17 THEN 'S' WHEN p_size < 34 THEN 'M' ELSE 'L' END AS size_class, {_KEYWORDS} AS keywords FROM part""")
def enrich_part(spark, sf_dir) -> DataFrame:
    color = F.when(text.term_present(F.col("p_name"), "red"), "red").when(text.term_present(F.col("p_name"), "blue"), "blue").when(text.term_present(F.col("p_name"), "green"), "green")
    size = F.when(F.col("p_size") < 17, "S").when(F.col("p_size") < 34, "M").otherwise("L")
    words = text.seo_keywords(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", color.alias("color"), size.alias("size_class"), F.array_join(words, "|").alias("keywords"))


@query("confidence_score", """SELECT p_partkey, round((CASE WHEN length(p_name) < 4 THEN 3.0 * 0.65 ELSE 3.0 END + 2.0 + CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1.5 END + 1.0 + 0.5) / 8.0, 4) AS confidence FROM part""")
def confidence_score(spark, sf_dir) -> DataFrame:
    fields = {"title": F.col("p_name"), "price": F.col("p_retailprice").cast("string"), "brand": F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")), "type": F.col("p_type"), "size": F.col("p_size").cast("string")}
    return table(spark, sf_dir, "part").select("p_partkey", records.confidence(fields).alias("confidence"))


@query("public_firewall", """SELECT field, reason, keep, count(*) AS n FROM (SELECT unnest([{'f': 'title', 'r': ''}, {'f': 'price', 'r': CASE WHEN p_partkey % 5 = 0 THEN 'shape' ELSE '' END}, {'f': '_source', 'r': 'internal'}, {'f': 'brand', 'r': CASE WHEN p_partkey % 7 = 0 THEN 'empty' ELSE '' END}, {'f': 'cost', 'r': 'not_allowed'}]) AS u FROM part), LATERAL (SELECT u.f AS field, u.r AS reason, u.r = '' AS keep) GROUP BY ALL""")
def public_firewall(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    data = F.create_map(
        F.lit("title"), F.col("p_name"), F.lit("price"), F.when(key % 5 == 0, "ask").otherwise(F.col("p_retailprice").cast("string")), F.lit("_source"), F.lit("table"),
        F.lit("brand"), F.when(key % 7 == 0, " ").otherwise(F.col("p_brand")), F.lit("cost"), F.lit("1"),
    )
    rows = records.firewall(table(spark, sf_dir, "part").select(key.alias("record_id"), data.alias("data")))
    return rows.groupBy("field", "reason", "keep").agg(F.count("*").alias("n"))


@query("content_fingerprint", """SELECT p_partkey, sha256('{"brand":"' || lower(p_brand) || '","title":"' || lower(p_name) || '"}') AS fingerprint FROM part""")
def content_fingerprint(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", records.content_fingerprint({"title": F.col("p_name"), "brand": F.col("p_brand"), "sku": F.lit("")}, F.lit("")).alias("fingerprint"))


@query("dup_documents", "SELECT fingerprint, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS fingerprint FROM documents) GROUP BY fingerprint HAVING count(*) > 1")
def dup_documents(spark, sf_dir) -> DataFrame:
    """Documents equal but for case and white space; only 32-byte digests are shuffled."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.collapsed(F.lower("text")), 256).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("audit_issues", """SELECT category, severity, field, count(*) AS n FROM (SELECT unnest([CASE WHEN p_size < 5 THEN {'category': 'suspicious', 'severity': 'low', 'field': 'size'} END, CASE WHEN p_retailprice > 1000 THEN {'category': 'incorrect', 'severity': 'high', 'field': 'price'} END,
 CASE WHEN NOT contains(p_name, ' ') THEN {'category': 'missing', 'severity': 'medium', 'field': 'title'} END, CASE WHEN p_type = 'PROMO' THEN {'category': 'pollution', 'severity': 'medium', 'field': 'type'} END]) AS i FROM part), LATERAL (SELECT i.category AS category, i.severity AS severity, i.field AS field) WHERE category IS NOT NULL GROUP BY ALL""")
def audit_issues(spark, sf_dir) -> DataFrame:
    rules = [
        ("suspicious", "low", "size", F.col("p_size") < 5), ("incorrect", "high", "price", F.col("p_retailprice") > 1000),
        ("missing", "medium", "title", ~F.contains("p_name", F.lit(" "))), ("pollution", "medium", "type", F.col("p_type") == "PROMO"),
    ]
    return records.audit(table(spark, sf_dir, "part"), "p_partkey", rules).groupBy("category", "severity", "field").agg(F.count("*").alias("n"))


@query("variants_merge", """SELECT l_partkey, l_suppkey, count(*) AS merged, arg_min(l_tax, (-r, ord)) FILTER (l_tax IS NOT NULL) AS l_tax, arg_min(l_discount, (-r, ord)) FILTER (l_discount IS NOT NULL) AS l_discount FROM (
 SELECT l_partkey, l_suppkey, nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount, l_orderkey * 10 + l_linenumber AS ord, (l_tax <> 0)::INT + (l_discount <> 0)::INT AS r FROM lineitem) GROUP BY l_partkey, l_suppkey""")
def variants_merge(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.nullif("l_tax", F.lit(0)).alias("l_tax"), F.nullif("l_discount", F.lit(0)).alias("l_discount"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return records.merge_variants(rows, ["l_partkey", "l_suppkey"], ["l_tax", "l_discount"])


@query("field_keys_normalized", """SELECT DISTINCT p_type AS raw, trim(lower(regexp_replace(p_type, '[^A-Za-z0-9_.]+', '_', 'g')), '_.') AS key FROM part""")
def field_keys_normalized(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("raw"), text.field_key(F.col("p_type")).alias("key")).distinct()


@query("record_scores", """SELECT p_partkey, 6 + CASE WHEN length(p_name) >= 12 THEN 1 ELSE 0 END + 6 + CASE WHEN p_partkey % 7 <> 0 THEN 2 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN -16 ELSE 0 END AS score FROM part""")
def record_scores(spark, sf_dir) -> DataFrame:
    """Additive row score of listings: title, price, brand; utility rows lose."""
    one = lambda c, n: F.when(c, n).otherwise(0)
    score = one(F.col("p_name") != "", 6) + one(F.length("p_name") >= 12, 1) + one(F.col("p_retailprice") > 0, 6) + one(F.col("p_partkey") % 7 != 0, 2) + one(F.col("p_type") == "PROMO", -16)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))
