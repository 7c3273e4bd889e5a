"""Scans of structured documents and joins of one kind of row, on odd inputs."""

from pyspark.sql import functions as F

from brindle.operators import links
from brindle.sources import structured


def test_json_ld_of_odd_pages(spark):
    pages = spark.createDataFrame(
        [
            (1, None), (2, ""), (3, "<p>none</p>"), (4, '<script type="application/ld+json">{broken</script>'), (5, '<script type="application/ld+json"> [] </script>'),
            (6, '<script type="application/ld+json">{"@graph":[{"@type":"Person","name":"b"},{"@type":"Offer"}]}</script><SCRIPT id="x" type="application/ld+json">{"@type":"Product"}</SCRIPT>'),
        ],
        "id int, html string",
    )
    got = {r["id"]: r["n"] for r in pages.select("id", structured.json_ld_nodes(F.col("html")).alias("n")).collect()}
    assert [got[i] for i in range(1, 6)] == [[]] * 5
    assert got[6] == ['{"@type":"Product"}', '{"@type":"Offer"}', '{"@type":"Person","name":"b"}']


def test_sitemap_forms(spark):
    xml = '<urlset><url><loc> http://a/?x=1&amp;y=2 </loc></url><url><s:loc><![CDATA[https://b/c]]></s:loc></url><url><loc>ftp://no</loc></url><url><loc>http://a/?x=1&amp;y=2</loc></url></urlset>'
    rows = spark.createDataFrame([(xml,), (None,), ("",)], "xml string").select(structured.sitemap_urls(F.col("xml")).alias("u")).collect()
    assert [r["u"] for r in rows] == [["http://a/?x=1&y=2", "https://b/c"], None, []]


def test_json_listing_forms(spark):
    bodies = ['{"results":[{"url":"u"},{"url":"u"}]}', '{"other":1}', "no json", None]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select(structured.json_listing(F.col("b"), "struct<title:string,url:string>").alias("l")).collect()
    assert [r["l"] and [tuple(x) for x in r["l"]] for r in rows] == [[(None, "u")], None, None, None]


def test_boxes_meet_once(spark):
    boxes = [("p", 1, 0, 500, 100, 600, "/a"), ("p", 2, 20, 520, 10, 2000, "/a"), ("p", 3, 0, 5000, 10, 10, None), ("q", 4, 0, 500, 100, 600, "/a"), ("p", 5, None, None, 1, 1, "/a"), ("p", 6, 10, 900, 5, 5, "/b")]
    got = links.box_clusters(spark.createDataFrame(boxes, "page string, id int, x int, y int, w int, h int, href string")).collect()
    assert sorted(map(tuple, got)) == [("p", 1, 1), ("p", 1, 2), ("p", 2, 1), ("p", 2, 2), ("p", 6, 6), ("q", 4, 4)]


def test_sizes_of_clusters_are_those_of_all_pairs(spark):
    boxes = [("pq"[i % 2], i, i * 7 % 5 * 60, None if i == 40 else i * 11 % 6 * 300, 50, 40 + i % 2 * 700, [None, "/a", "/b"][i % 3]) for i in range(120)]
    table = spark.createDataFrame([*boxes, *((p, 1000 + i, *rest) for p, i, *rest in boxes)], "page string, id int, x int, y int, w int, h int, href string")
    pairs = links.box_clusters(table).groupBy("page", "id").agg(F.count("*").alias("n"), F.min("other").alias("first"))
    sizes = links.box_cluster_sizes(table)
    assert sorted(map(tuple, sizes.collect())) == sorted(map(tuple, pairs.collect())) and sizes.count() > 50


def test_denied_suffixes(spark):
    rows = spark.createDataFrame([(1, "a.b.com"), (2, "xb.com"), (3, "b.com"), (4, ""), (5, None)], "id int, host string")
    denied = spark.createDataFrame([("b.com",), (None,), ("b.com",)], "domain string")
    assert sorted(r["id"] for r in links.without_domains(rows, "id", "host", denied).collect()) == [2, 4, 5]


def test_versions_of_empty_tables(spark):
    a = spark.createDataFrame([(1, 10.0, "x"), (2, None, None)], "k int, p double, s string")
    none = a.limit(0)
    assert {tuple(r) for r in links.compared(a, none, "k", "p", "s").collect()} == {(1, "missing"), (2, "missing")}
    assert {tuple(r) for r in links.compared(a, a, "k", "p", "s").collect()} == {(1, "same"), (2, "same")} and links.compared(none, none, "k", "p", "s").count() == 0
