"""Queries that link records: two captures of the same sites in order, products and the categories of a taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import urls
from brindle.operators import alignment, taxonomy
from brindle.plans.registry import query, table


#: Ids of captured pages in a batch.
BATCH = 500


def captures(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The captured pages of each site and batch, and a later capture: some lost, some moved to another path or host, some retitled, some new."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    pages = table(spark, sf_dir, "pages").select(F.concat_ws("#", urls.registrable_host(F.col("url")), F.floor(F.col("page_id") / BATCH)).alias("site"), "page_id", "url", title.alias("title"))
    key, path = F.col("page_id"), urls.url_path(F.col("url"))
    host = urls.authority(F.col("url"))
    moved = F.when(key % 9 == 4, F.concat(F.lit("https://"), host, F.lit("/moved/"), key)).when(key % 9 == 7, F.concat(F.lit("http://mirror.example.info"), path)).otherwise(F.col("url"))
    retitled = F.when(key % 27 == 4, F.concat(F.lit("Now "), F.col("title"))).when(key % 27 == 13, F.lit(None)).otherwise(F.col("title"))
    kept = pages.where("page_id % 11 <> 5").select("site", "page_id", moved.alias("url"), retitled.alias("title"))
    new = pages.where("page_id % 17 = 3").select("site", "page_id", F.concat(F.lit("https://"), host, F.lit("/new/n"), key).alias("url"), F.lit("New on this site").alias("title"))
    return pages, kept.unionByName(new)


@query("captures_aligned")
def captures_aligned(spark, sf_dir) -> DataFrame:
    """Both captures of each site and batch aligned by page_id: a walk with titles as like as 0.82, which SQL hasn't; tested against brute force."""
    return alignment.aligned(*captures(spark, sf_dir), "site", "page_id", "url", "title")


def _bag(text: str) -> str:
    one = "CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 4 AND regexp_matches(t, '(ss|x|ch|sh)es$') THEN t[:-3] WHEN length(t) > 3 AND regexp_matches(t, '[^s]s$') THEN t[:-2] ELSE t END"
    return f"list_distinct(list_transform(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda t: t <> ''), lambda t: {one}))"


_CATEGORIES = "SELECT p_type || ' > ' || split_part(p_name, ' ', 2) || 's > ' || p_name || 's' AS category, p_type || ' ' || p_name || 's' AS leaf, min(p_brand) || ' large' AS attributes FROM part GROUP BY p_type, p_name"
_POOLS = "SELECT p_partkey AS product_id, CASE p_partkey % 10 WHEN 0 THEN upper(p_type || ' > ' || split_part(p_name, ' ', 2) || 's > ' || p_name || 's') WHEN 1 THEN p_type || '  ' || p_name || 's ' ELSE '' END AS value, CASE WHEN p_partkey % 4 > 0 THEN p_type ELSE '' END AS first, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' of steel' ELSE '' END AS second, p_brand AS third FROM part"
CONFLICTS = [(["blue", "hot bolt"], ["economy"]), (["rings"], ["small rings", "red rings"])]


@query("categories_ranked", f"""WITH c AS (SELECT *, {_bag('category')} AS path, list_filter({_bag('attributes')}, lambda t: NOT list_contains({_bag('category')}, t)) AS more FROM ({_CATEGORIES})),
 p AS (SELECT *, {_bag('first')} AS a, {_bag('second')} AS b, {_bag('third')} AS d FROM ({_POOLS})),
 exact AS (SELECT product_id, category, CASE WHEN lower(value) = lower(category) THEN 1.0 ELSE 0.92 END AS score, 'exact_match' AS source, 1 AS rank FROM p JOIN c ON lower(value) = lower(category) OR trim(regexp_replace(lower(value), ' +', ' ', 'g')) = lower(leaf)),
 pairs AS (SELECT product_id, category, list_distinct(a || b || d) AS words, more, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, path)) / len(a) END AS one, len(list_intersect(b, path)) / len(b) * CAST(0.35 AS DOUBLE) AS two, len(list_intersect(d, path)) / len(d) * CAST(0.15 AS DOUBLE) AS three FROM p, c WHERE product_id NOT IN (SELECT product_id FROM exact)),
 total AS (SELECT *, one + two + three + len(list_intersect(words, more)) / len(words) * CAST(0.3 AS DOUBLE) AS sum FROM pairs),
 scored AS (SELECT product_id, category, CASE WHEN one = 0 THEN sum * CAST(0.6 AS DOUBLE) ELSE sum END AS score FROM total WHERE NOT ((list_contains(words, 'blue') OR (list_contains(words, 'hot') AND list_contains(words, 'bolt'))) AND contains(lower(category), 'economy'))
  AND NOT (list_contains(words, 'ring') AND (contains(lower(category), 'small rings') OR contains(lower(category), 'red rings'))))
 SELECT product_id, category, CAST(score AS DOUBLE) AS score, source, CAST(rank AS INTEGER) AS rank FROM exact UNION ALL
 SELECT product_id, category, score, 'scored_match', CAST(rank AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, length(category), category) AS rank FROM (SELECT product_id, category, round(score, 3) AS score FROM scored WHERE score >= 0.42)) WHERE rank <= 5""")
def categories_ranked(spark, sf_dir) -> DataFrame:
    """Parts under categories made from types and names: some name a path or a leaf, the others are scored by type, name and brand."""
    part = table(spark, sf_dir, "part")
    key, kind, name = F.col("p_partkey"), F.col("p_type"), F.col("p_name")
    path = F.concat(kind, F.lit(" > "), F.split_part(name, F.lit(" "), F.lit(2)), F.lit("s > "), name, F.lit("s"))
    shelf = part.groupBy(path.alias("category"), F.concat(kind, F.lit(" "), name, F.lit("s")).alias("leaf")).agg(F.concat(F.min("p_brand"), F.lit(" large")).alias("attributes"))
    value = F.when(key % 10 == 0, F.upper(path)).when(key % 10 == 1, F.concat(kind, F.lit("  "), name, F.lit("s "))).otherwise("")
    second = F.concat(name, F.when(key % 3 == 0, F.lit(" of steel")).otherwise(F.lit("")))
    products = part.select(key.alias("product_id"), value.alias("value"), F.when(key % 4 > 0, kind).otherwise("").alias("first"), second.alias("second"), F.col("p_brand").alias("third"))
    return taxonomy.ranked_categories(products, shelf, conflicts=CONFLICTS)
