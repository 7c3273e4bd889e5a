"""Merkle trees over sections, paragraphs and phrases, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import partitions, table, text_or_empty

#: A section ends where a blank line or a heading line begins; a paragraph is a line.
_SECTION = r"(?=\n[ \t]*\n)|(?=\n#{1,6} )"
#: A phrase, the leaf below a paragraph: up to eight words, ended sooner by a mark of punctuation.
_PHRASE = r"\s*(?:[^\s.,;:!?|]+[ \t]+){0,7}[^\s.,;:!?|]*[.,;:!?|]*"
#: Boundaries kept in a row of the two-level table of id ranges.
FAN = 64


def _node(kind: str, children: Column) -> Column:
    return F.sha2(F.concat_ws("", F.lit(kind), children), 256)


def tree(text: Column) -> Column:
    """array<struct<hash, paragraphs array<struct<hash, text_length, phrases array<bigint>>>>>: the sections of a text.

    A paragraph's hash is of its text, a section's of its paragraphs' hashes; ``root`` hashes the
    sections' in turn. Cuts keep every character, so equal texts have equal trees and others don't.
    """
    paragraph = lambda p: F.struct(
        F.sha2(p, 256).alias("hash"),
        F.char_length(p).alias("length"),
        F.transform(F.regexp_extract_all(p, F.lit(_PHRASE), 0), lambda x: F.xxhash64(F.trim(x))).alias("phrases"),
    )

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n"), paragraph)

    return F.transform(F.transform(F.split(text, _SECTION), section), lambda ps: F.struct(_node("s", F.transform(ps, lambda p: p["hash"])).alias("hash"), ps.alias("paragraphs")))


def root(sections: Column) -> Column:
    return _node("d", F.transform(sections, lambda s: s["hash"]))


def leaves(sections: Column) -> Column:
    """The distinct leaves of a tree, without the leaf of empty phrases."""
    empty = F.xxhash64(F.lit(""))
    return F.array_distinct(F.filter(F.flatten(F.flatten(F.transform(sections, lambda s: F.transform(s["paragraphs"], lambda p: p["phrases"])))), lambda x: x != empty))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 for equal roots, else twice the leaves in common over all leaves of the two trees; 0 without any."""
    both = F.size(leaves_a) + F.size(leaves_b)
    return F.when(root_a == root_b, 1.0).when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(leaves_a, leaves_b)) / both)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (the root) and tree of every whole text; a null text counts as empty.

    Rows are independent: repeated ones come out repeated, an empty table gives no rows, extra columns are
    ignored.
    """
    return docs.select("doc_id", tree(text_or_empty()).alias("tree")).select("doc_id", root(F.col("tree")).alias("fingerprint"), "tree")


def differing_paragraphs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where two versions differ: (doc_id, section, paragraph, hash_a, hash_b), sections and paragraphs from 0.

    Documents with equal roots are left out first, then sections with equal hashes; only what is
    left is exploded. A section or paragraph that one side lacks has a null hash. ``doc_id`` should be unique.
    """
    sides = [x.select("doc_id", F.col("fingerprint").alias(f"root_{n}"), F.col("tree").alias(f"tree_{n}")) for x, n in ((a, "a"), (b, "b"))]
    pairs = sides[0].join(sides[1], "doc_id").where("root_a <> root_b")
    zipped = pairs.select("doc_id", F.posexplode(F.arrays_zip("tree_a", "tree_b")).alias("section", "pair"))
    unlike = zipped.where(~F.col("pair.tree_a.hash").eqNullSafe(F.col("pair.tree_b.hash")))
    none = F.array().cast("array<string>")
    hashes = [F.coalesce(F.col(f"pair.tree_{n}.paragraphs.hash"), none).alias(f"p{n}") for n in "ab"]
    listed = unlike.select("doc_id", "section", *hashes).select("doc_id", "section", F.posexplode(F.arrays_zip("pa", "pb")).alias("paragraph", "pair"))
    return listed.select("doc_id", "section", "paragraph", F.col("pair.pa").alias("hash_a"), F.col("pair.pb").alias("hash_b")).where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def _ranges(docs: DataFrame) -> tuple[Column, int]:
    """A column with the number of a row's range of doc_ids, in ascending order, and how many ranges there are.

    The boundaries are approximate quantiles: at most ``FAN`` * ``FAN`` numbers, whatever the input, in
    two levels, so that a row looks at 2 * ``FAN`` of them. Null ids come before all others.
    """
    inner = max(1, min(FAN, -(-4 * partitions(docs.sparkSession) // FAN)))
    n = FAN * inner
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    rows = [cuts[i : i + FAN] for i in range(0, len(cuts), FAN)]
    if not rows:
        return F.lit(0), 1
    table_ = F.array(*(F.array(*map(F.lit, r)) for r in rows))
    first = F.array(*(F.lit(r[0]) for r in rows))
    row = F.size(F.filter(first, lambda x: x < F.col("doc_id")))
    within = F.size(F.filter(F.element_at(table_, F.greatest(row, F.lit(1))), lambda x: x < F.col("doc_id")))
    number = F.when(row == 0, 0).otherwise((row - 1) * FAN + within)
    return F.coalesce(number, F.lit(0)).cast("int"), len(cuts) + 1


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the row that follows in descending doc_id; after the last comes the first.

    Rows are dealt by ranges of ids; the rows with a range's greatest id, which follow the range above, go
    there too. So each text is shuffled once, and no task sees more than a range. Rows with one doc_id come
    in the order of their texts; a null doc_id comes last; a lone row follows itself.
    """
    number, _ = _ranges(docs)
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("range", number)
    tops = rows.groupBy("range").agg(F.max("doc_id").alias("top")).withColumn("above", F.lead("range").over(Window.orderBy("range")))
    tops = tops.withColumn("above", F.coalesce("above", F.min("range").over(Window.partitionBy())))
    sent = rows.join(F.broadcast(tops.select("range", "top", "above")), "range").withColumn("lent", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    placed = sent.select("doc_id", "text", "lent", F.when(F.col("lent"), F.col("above")).otherwise(F.col("range")).alias("range"))
    order = Window.partitionBy("range").orderBy("lent", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return placed.select("doc_id", "text", "lent", F.lead("text").over(order).alias("next_text")).where(~F.col("lent")).drop("lent")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of an edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next
    document's. Null texts count as empty; see ``with_next`` for ties and repeated rows.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    trees = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(tree(F.col(c)).alias(f"tree_{c}") for c in ("text", "edited", "next_text")))
    flat = trees.select(
        "doc_id", "n_chars", "edited_sha256", *(x for c in ("text", "edited", "next_text") for x in (root(F.col(f"tree_{c}")).alias(f"root_{c}"), leaves(F.col(f"tree_{c}")).alias(f"leaves_{c}")))
    )
    like = lambda c: likeness(F.col("root_text"), F.col("leaves_text"), F.col(f"root_{c}"), F.col(f"leaves_{c}"))
    return flat.select(
        "doc_id", "n_chars", "edited_sha256", F.col("root_text").alias("fingerprint"), F.col("root_edited").alias("edited_fingerprint"),
        like("edited").alias("near_edited"), like("next_text").alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
