"""WARC records and a Merkle fixity audit: trees over records and their offset ranges, compared from the root down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import table, text_or_empty, written

#: Records of a WARC file, about; children of a node; levels over the records, the root included.
FILE, FANOUT, LEVELS = 1_000, 16, 3
#: Copies of a page_id that may lie in one file; those of ids with more are dealt out.
COPIES = 100


def records(pages: DataFrame, files: int | None = None) -> DataFrame:
    """(page_id, file, record): each page as a WARC 1.0 response record; a null url or html counts as empty.

    Pages go to files by a hash of page_id (by default about ``FILE`` records each), so ids with a stride are dealt evenly too; those
    without an id, or with one that more than ``COPIES`` share, by a hash of the record. Only exact copies of such a record share a file.
    """
    if files is None:
        files = max(1, -(-pages.count() // FILE))
    body = text_or_empty("html")
    url = text_or_empty("url")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    rows = pages.select(F.col("page_id").cast("long"), F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))
    shared = rows.where("page_id IS NOT NULL").groupBy("page_id").count().where(F.col("count") > COPIES).select("page_id", F.lit(True).alias("_shared"))
    own = F.col("page_id")
    if not shared.isEmpty():  # at most one id in COPIES rows
        rows, own = rows.join(F.broadcast(shared), "page_id", "left"), F.when(F.col("_shared").isNull(), own)
    hashed = F.conv(F.left(F.md5(own.cast("string")), F.lit(8)), 16, 10).cast("long")
    file = F.pmod(F.coalesce(hashed, F.xxhash64("record")), F.lit(files)).cast("int")
    return rows.select("page_id", file.alias("file"), "record")


def layout(rows: DataFrame) -> DataFrame:
    """(file, position, page_id, start, length, record_sha256, hash): where each record of a file is, and its leaf.

    Records lie in the order of page_id, nulls first, equal ids by their digests. Only digests and lengths are
    shuffled, and a file's records are bounded by ``records``. The leaf hashes the digest and the offset range.
    """
    digests = rows.select("file", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("record_sha256"))
    order = Window.partitionBy("file").orderBy("page_id", "record_sha256")
    placed = digests.withColumn("position", (F.row_number().over(order) - 1).cast("long")).withColumn("start", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    leaf = F.sha2(F.concat_ws(":", F.col("start").cast("string"), F.col("length").cast("string"), "record_sha256"), 256)
    return placed.select("file", "position", "page_id", "start", "length", "record_sha256", leaf.alias("hash"))


def trees(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The levels (file, position, hash, start, end) over the leaves, the lowest first, each a written table; the last holds a root a file."""
    below = leaves.select("file", "position", "hash", "start", (F.col("start") + F.col("length")).alias("end"))
    out = []
    for level in range(1, levels + 1):
        parent = F.lit(0).cast("long") if level == levels else F.floor(F.col("position") / FANOUT)
        below = written(
            below.withColumn("position_", parent)
            .groupBy("file", "position_")
            .agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash"), F.min("start").alias("start"), F.max("end").alias("end"))
            .withColumnRenamed("position_", "position"),
            "tree",
        )
        out.append(below)
    return out


def _unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, position) that only one side has or whose hashes differ."""
    both = a.select("file", "position", F.col("hash").alias("hash_a")).join(b.select("file", "position", F.col("hash").alias("hash_b")), ["file", "position"], "full")
    return both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file", "position")


def audit(a: DataFrame, b: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(page_id, file, position, status, start, other_start) of the records of replica ``a`` that replica ``b`` doesn't hold alike, and b's extra ones.

    ``a`` and ``b`` are written layouts. Roots are compared first; then, level by level, only the children of
    unlike nodes. status: corrupt (other bytes), moved (same bytes, another offset), missing (not in b), extra
    (not in a). Records are told apart by page_id within a file; repeated ones by their order. position is that in
    ``a``, null of extra ones.
    """
    levels_a, levels_b = trees(a, levels), trees(b, levels)
    branches = written(_unlike(levels_a[-1], levels_b[-1]), "unlike")
    for level in range(levels - 2, -2, -1):
        below = [x[level] if level >= 0 else leaves for x, leaves in ((levels_a, a), (levels_b, b))]
        parent = F.lit(0).cast("long") if level == levels - 2 else F.floor(F.col("position") / FANOUT)
        chosen = branches.withColumnRenamed("position", "_parent")
        below = [x.withColumn("_parent", parent).join(chosen, ["file", "_parent"], "left_semi") for x in below]
        branches = written(_unlike(*below), "unlike")
    nth = F.row_number().over(Window.partitionBy("file", "page_id").orderBy("position"))
    sides = [x.join(branches, ["file", "position"], "left_semi").withColumn("nth", nth).select("file", "page_id", "nth", "position", F.col("start").alias(f"start_{n}"), F.col("record_sha256").alias(f"sha_{n}")) for x, n in ((a, "a"), (b, "b"))]
    x, y = sides[0].alias("x"), sides[1].alias("y")
    joined = x.join(y, (F.col("x.file") == F.col("y.file")) & F.col("x.page_id").eqNullSafe(F.col("y.page_id")) & (F.col("x.nth") == F.col("y.nth")), "full")
    status = F.when(F.col("sha_b").isNull(), "missing").when(F.col("sha_a").isNull(), "extra").when(F.col("sha_a") == F.col("sha_b"), "moved").otherwise("corrupt")
    return joined.select(F.coalesce("x.page_id", "y.page_id").alias("page_id"), F.coalesce("x.file", "y.file").alias("file"), F.col("x.position"), status.alias("status"), F.col("start_a").alias("start"), F.col("start_b").alias("other_start"))


def damaged(rows: DataFrame) -> DataFrame:
    """A replica with known damage: records of page_id % 389 = 7 are gone, those of page_id % 97 = 5 have their last line in capitals."""
    changed = F.concat(F.expr("left(record, greatest(char_length(record) - 12, 0))"), F.upper(F.expr("right(record, 12)")))
    return rows.where("NOT coalesce(page_id % 389 = 7, false)").withColumn("record", F.when(F.col("page_id") % 97 == 5, changed).otherwise(F.col("record")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of ``pages`` with its offset, its digest and what the audit against a damaged replica says of it."""
    rows = records(table(spark, sf_dir, "pages"))
    a, b = written(layout(rows), "replica_a"), written(layout(damaged(rows)), "replica_b")
    found = audit(a, b).where("status <> 'extra'").select("file", "position", "status", "other_start")
    out = a.join(found, ["file", "position"], "left")
    return out.select("page_id", "file", "position", "start", "length", "record_sha256", F.coalesce("status", F.lit("intact")).alias("status"), F.when(F.col("status").isNull(), F.col("start")).otherwise(F.col("other_start")).alias("other_start"))


OP9_SQL = """
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 1000.0) AS BIGINT)) AS files FROM pages),
r AS (SELECT page_id, CAST(CAST('0x' || left(md5(CAST(page_id AS VARCHAR)), 8) AS BIGINT) % n.files AS INTEGER) AS file,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
  || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages, n),
d AS (SELECT page_id, file, CASE WHEN page_id % 97 = 5 THEN left(record, length(record) - 12) || upper(right(record, 12)) ELSE record END AS record FROM r WHERE page_id % 389 <> 7),
a AS (SELECT page_id, file, row_number() OVER w - 1 AS position, CAST(sum(strlen(record)) OVER w - strlen(record) AS BIGINT) AS start, strlen(record) AS length, sha256(record) AS record_sha256 FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id)),
b AS (SELECT page_id, CAST(sum(strlen(record)) OVER w - strlen(record) AS BIGINT) AS other_start, sha256(record) AS sha_b FROM d WINDOW w AS (PARTITION BY file ORDER BY page_id))
SELECT page_id, file, position, start, length, record_sha256,
  CASE WHEN sha_b IS NULL THEN 'missing' WHEN sha_b <> record_sha256 THEN 'corrupt' WHEN other_start <> start THEN 'moved' ELSE 'intact' END AS status, other_start
FROM a LEFT JOIN b USING (page_id)
"""
