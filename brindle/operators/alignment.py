"""Two lists of records, such as two captures of one site, aligned in their order: an exact walk with one look-ahead, in blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text, urls
from brindle.operators import prefix
from brindle.session import shared_dir

#: Rows of the left list in a block. A block reads at most twice as many of the right list.
BLOCK = 256
#: How like two titles of one host are at least to tell one record.
LIKE = 0.82
MATCHED, FORCED, MISSING, EXTRA = "matched", "forced", "missing", "extra"
MARKS = ["_url", "_host", "_two", "_one", "_ids", "_title"]


def marks(url: Column, title: Column) -> dict[str, Column]:
    """What tells a record: its URL without query, the name of its host, the last two and the last parts of its path, the tokens of
    five characters or more with a digit in it, its title. A null or blank URL gives ''."""
    url = F.coalesce(F.trim(url), F.lit(""))
    path = F.lower(F.regexp_replace(F.regexp_replace(urls.url_path(url), "/+$", ""), "/+", "/"))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    tail = lambda n: F.array_join(F.slice(parts, -F.least(F.lit(n), F.size(parts)), n), "/")
    some = lambda n: F.when(F.size(parts) > 0, tail(n)).otherwise("")
    whole = F.concat(F.lower(F.regexp_extract(url, "^[^:/?#]*:", 0)), F.lit("//"), urls.authority(url), path)
    ids = F.array_distinct(F.filter(F.regexp_extract_all(path, F.lit("([a-z0-9]{5,})"), 1), lambda t: t.rlike("[0-9]")))
    return {
        "_url": F.when(url != "", whole).otherwise(""), "_host": F.when(url != "", F.split(urls.registrable_host(url), r"\.")[0]).otherwise(""), "_two": some(2), "_one": some(1),
        "_ids": F.coalesce(ids, F.array().cast("array<string>")), "_title": F.coalesce(F.lower(text.collapsed(title)), F.lit("")),
    }


def same_record(left: Sequence, right: Sequence) -> bool:
    """Whether two rows of ``MARKS`` are of one record: one URL, or one host and the end of a path, an id or a title in common."""
    if left[0] == right[0]:
        return True
    if left[1] != right[1]:
        return False
    if left[2] == right[2] or left[3] == right[3] or not set(left[4]).isdisjoint(right[4]):
        return True
    if not left[5] or not right[5]:
        return False
    blocks = SequenceMatcher(None, right[5], left[5])
    return blocks.real_quick_ratio() >= LIKE and blocks.quick_ratio() >= LIKE and blocks.ratio() >= LIKE


def walk(left: Sequence[Sequence], right: Sequence[Sequence], own: int) -> Iterator[tuple[int | None, int | None, str]]:
    """(place in left, place in right, outcome) until the first ``own`` of ``left`` are placed; the rest of ``left`` is only looked ahead at.

    Two rows that aren't one record are forced together, unless exactly one of them meets the other list's next row: then the other waits.
    """
    i = j = 0
    while i < own:
        if j >= len(right):
            yield i, None, MISSING
            i += 1
        elif same_record(left[i], right[j]):
            yield i, j, MATCHED
            i, j = i + 1, j + 1
        else:
            left_waits = j + 1 < len(right) and same_record(left[i], right[j + 1])
            right_waits = i + 1 < len(left) and same_record(left[i + 1], right[j])
            if right_waits and not left_waits:
                yield i, None, MISSING
                i += 1
            elif left_waits and not right_waits:
                yield None, j, EXTRA
                j += 1
            else:
                yield i, j, FORCED
                i, j = i + 1, j + 1


def _written(rows: DataFrame, name: str) -> DataFrame:
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _numbered(rows: DataFrame, key: str, order: str, url: str, title: str) -> DataFrame:
    """(_group, _id, MARKS, _place from 0 in the group): written once, so a lost executor can't number rows of one order anew."""
    group = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    read = rows.select(group.alias("_group"), F.col(order).cast("long").alias("_id"), *(c.alias(name) for name, c in marks(F.col(url), F.col(title)).items()))
    placed = prefix.running(read, "_group", ["_id", "_url", "_title"], {"_place": (prefix.SUM, F.lit(1))})
    return _written(placed.select("_group", "_id", *MARKS, (F.col("_place") - 1).cast("long").alias("_place")), "numbered")


def _walked(blocks: DataFrame, left: DataFrame, right: DataFrame, block: int, ends: bool) -> DataFrame:
    """Walks ``blocks`` (_group, _block, _start): where each ends in the right list, or its outcomes."""
    at = lambda c: F.floor(F.col(c) / block)
    # The first row of a block is also what the block before it looks ahead at.
    views = left.withColumn("_block", F.explode(F.when((F.col("_place") % block == 0) & (F.col("_place") > 0), F.array(at("_place"), at("_place") - 1)).otherwise(F.array(at("_place")))))
    own = views.join(blocks, ["_group", "_block"])
    spans = blocks.withColumn("_part", F.explode(F.sequence(at("_start"), F.floor((F.col("_start") + 2 * block) / block))))
    other = right.withColumn("_part", at("_place")).join(spans, ["_group", "_part"]).where("_place >= _start").where(F.col("_place") <= F.col("_start") + 2 * block)
    other = other.select(*(F.col(c).alias(c) for c in ("_group", "_block", "_id", *MARKS, "_place")))  # own columns, for a cogroup tells sides by them

    def one(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = mine.sort_values("_place"), theirs.sort_values("_place")
        group, number, start = mine["_group"].iloc[0], int(mine["_block"].iloc[0]), int(mine["_start"].iloc[0])
        a, b = (list(zip(*(side[m] for m in MARKS))) for side in (mine, theirs))
        steps = list(walk(a, b, int((mine["_place"] // block == number).sum())))
        if ends:
            return pd.DataFrame({"_group": [group], "_block": [number], "_end": [start + sum(j is not None for _, j, _ in steps)]})
        ids = [list(side["_id"]) for side in (mine, theirs)]
        pick = lambda values, k: None if k is None or pd.isna(values[k]) else int(values[k])
        return pd.DataFrame([(group, pick(ids[0], i), pick(ids[1], j), how) for i, j, how in steps], columns=["_group", "left_id", "right_id", "alignment"]).astype({"left_id": "Int64", "right_id": "Int64"})

    schema = "_group string, _block long, _end long" if ends else "_group string, left_id long, right_id long, alignment string"
    return own.groupBy("_group", "_block").cogroup(other.groupBy("_group", "_block")).applyInPandas(one, schema)


def aligned(left: DataFrame, right: DataFrame, key: str, order: str, url: str, title: str, block: int = BLOCK) -> DataFrame:
    """(key as text, left_id, right_id, alignment): the rows of both lists of each ``key``, aligned along ``order`` (a whole number).

    ``matched`` rows are one record, ``forced`` ones meet without being one, ``missing`` are of the left list alone, ``extra`` of the
    right alone. Every row of both lists is in the result once. The left list is cut into blocks; where a block starts in the right list
    depends on the block before. So all blocks are walked from a guess, and those whose start was another are walked again, until
    none is: the result is that of one walk from the first row. A walk looks ahead by one row only, so from a start that is further
    off it doesn't find back, and then a round settles no more than one block of each key: there are as many rounds as blocks in the longest list,
    at worst. Keys should therefore be lists as they were captured, a batch each, not whole sites. No task sees more than three blocks.
    Rows of one order follow by URL, then title; null keys are a key of their own, null orders come first.
    """
    left, right = (_numbered(rows, key, order, url, title) for rows in (left, right))
    sizes = right.groupBy("_group").agg(F.count("*").alias("_n"))
    blocks = left.select("_group", F.floor(F.col("_place") / block).alias("_block")).distinct().join(sizes, "_group", "left")
    state = _written(blocks.select("_group", "_block", F.least(F.col("_block") * block, F.coalesce("_n", F.lit(0))).alias("_start"), F.lit(None).cast("long").alias("_end"), F.lit(True).alias("_open")), "starts")
    while True:
        found = _walked(state.where("_open").select("_group", "_block", "_start"), left, right, block, True).withColumnRenamed("_end", "_found")
        ended = _written(state.join(found, ["_group", "_block"], "left").select("_group", "_block", "_start", F.coalesce("_found", "_end").alias("_end")), "ends")
        before = ended.select("_group", (F.col("_block") + 1).alias("_block"), F.col("_end").alias("_begin"))
        begin = F.coalesce("_begin", "_start")
        state = _written(ended.join(before, ["_group", "_block"], "left").select("_group", "_block", begin.alias("_start"), "_end", (begin != F.col("_start")).alias("_open")), "starts")
        if state.where("_open").isEmpty():
            break
    last = state.groupBy("_group").agg(F.max("_end").alias("_end"))
    rest = right.join(last, "_group", "left").where(F.col("_place") >= F.coalesce("_end", F.lit(0)))
    rest = rest.select("_group", F.lit(None).cast("long").alias("left_id"), F.col("_id").alias("right_id"), F.lit(EXTRA).alias("alignment"))
    outcomes = _walked(state.select("_group", "_block", "_start"), left, right, block, False).unionByName(rest)
    return outcomes.select(F.when(F.col("_group") != "", F.substring("_group", 2, 1 << 20)).alias(key), "left_id", "right_id", "alignment")
