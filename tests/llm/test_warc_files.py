"""Records are dealt evenly to files whatever the stride of their ids."""

import pytest
from pyspark.sql import functions as F

from brindle.llm import common, warc


@pytest.mark.parametrize("stride", [1, 2, 4, 10, 1024])
def test_strided_ids_spread(spark, stride):
    pages = spark.range(0, 4_000 * stride, stride).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("h").alias("html"))
    sizes = sorted(r["count"] for r in warc.records(pages).groupBy("file").count().collect())
    assert len(sizes) == 4 and sizes[-1] < 1.15 * sizes[0]


def test_audit_of_many_files(spark):
    pages = spark.range(0, 12_000, 4).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), F.col("id")).alias("url"), F.repeat(F.lit("h"), F.col("id").cast("int") % 7).alias("html"))
    rows = warc.records(pages)
    a, b = common.written(warc.layout(rows), "a"), common.written(warc.layout(rows.where("page_id <> 400").withColumn("record", F.when(F.col("page_id") == 8, F.lit("x")).otherwise(F.col("record")))), "b")
    found = {r["page_id"]: r["status"] for r in warc.audit(a, b).collect()}
    assert found[400] == "missing" and found[8] == "corrupt"
    assert set(found.values()) <= {"missing", "corrupt", "moved"}
    files = {r["file"] for r in a.where("page_id IN (8, 400)").collect()}
    assert {r["file"] for r in warc.audit(a, b).collect()} == files
