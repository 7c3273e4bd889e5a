"""Cross-entropy difference: bigram models of a target and of the background over one vocabulary score each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table, written

#: The share any one word has in a model without counts; the same in both.
UNIFORM = 1e-6
#: Weight of the shorter history in counts, at each order.
BACKOFF = 5.0
#: Words of a batch of documents, about; n-grams of a bucket that meet in one task, about.
BATCH, BUCKET = 1_000_000, 1_500_000

_U = np.uint64
#: What comes before the first word and after the last; no word has white space.
START, END = (_U(xxhash.xxh3_64_intdigest(x)) for x in (b" ", b"  "))
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text: lower-case A-Z, parted by ASCII white space."""
    return (text or "").encode().lower().split()


class _Places(dict):
    """Word to its place in a batch's vocabulary, by first occurrence."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed: small or rare large ones take little."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=8 * size), dtype=np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def batches(docs: DataFrame) -> DataFrame:
    """The written table (batch, ids, lengths, size, vocabulary, words): documents in batches of about ``BATCH`` words.

    A batch has its own vocabulary, as 64-bit hashes from the most frequent word on, and all its texts as places in it.
    A longer document is a batch of its own.
    """
    kinds = "batch long, ids array<long>, lengths array<long>, size long, vocabulary binary, words binary"
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        places, ids, texts = _Places(), [], []

        def sent() -> pa.RecordBatch:
            nonlocal places, number
            own = np.concatenate(texts)
            order = np.argsort(-np.bincount(own, minlength=len(places)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, places), dtype=_U, count=len(places))[order]
            out = [[task + number], [ids[:]], [[len(t) for t in texts]], [len(own)], [hashes.tobytes()], [squeezed(rank[own])]]
            number += 1
            places = _Places()
            ids.clear()
            texts.clear()
            kind = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kind)], names)

        held = 0
        for batch in rows:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words_of(text.as_py())
                texts.append(np.fromiter(map(places.__getitem__, own), dtype=np.int32, count=len(own)))
                ids.append(doc_id)
                held += len(own) + 1
                if held >= BATCH:
                    yield sent()
                    held = 0
        if ids:
            yield sent()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds), "batches")


class Grams:
    """The n-grams of a batch: of each place of a text, its end among them, the word and the pair with the word before.

    ``keys`` are the distinct ones, sorted; ``n`` and ``t`` how often they stand in all and in target documents.
    ``at`` and ``own`` hold, of words and of pairs, each place's key and how often it stands in the same document.
    """

    def __init__(self, lengths: np.ndarray, vocabulary: bytes, words: bytes, size: int, targets: list[int]):
        self.target = np.zeros(len(lengths), bool)
        self.target[targets] = True
        held = np.where(lengths > 0, lengths + 1, 0)
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), held)
        ends = np.cumsum(held)[lengths > 0] - 1
        w = np.full(len(self.doc), END, dtype=_U)
        inner = np.ones(len(w), bool)
        inner[ends] = False
        w[inner] = np.frombuffer(vocabulary, dtype="<u8")[spread(words, size).astype(np.int64)]
        self.first = np.zeros(len(w), bool)
        self.first[ends - lengths[lengths > 0]] = True
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[self.first] = START
        pair = before * _A + (w << _U(31) | w >> _U(33)) * _B
        pair ^= pair >> _U(29)
        keys, n, t, self.at, self.own = [], [], [], [], []
        for kind in (w * _A, pair * _B):
            key = kind >> _U(8)
            order = np.argsort(key, kind="stable")  # so a key's places in one document stand together
            k, d = key[order], self.doc[order]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            stretch = new.copy()
            stretch[1:] |= d[1:] != d[:-1]
            group, part = np.cumsum(new, dtype=np.int32) - 1, np.cumsum(stretch, dtype=np.int32) - 1
            at, own = np.empty(len(k), np.int32), np.empty(len(k), np.int32)
            at[order], own[order] = group, np.bincount(part)[part]
            self.at.append(at)
            self.own.append(own)
            keys.append(k[new])
            n.append(np.bincount(group))
            t.append(np.bincount(group, self.target[d]).astype(np.int64))
        self.at[1] += len(keys[0])
        order = np.argsort(np.concatenate(keys), kind="stable")
        self.keys, self.n, self.t = (np.concatenate(x)[order] for x in (keys, n, t))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at = [place[x] for x in self.at]

    def cuts(self, buckets: int) -> np.ndarray:
        """Where each of ``buckets`` equal ranges of keys begins, and the end."""
        edges = [min((i << 56) // buckets, (1 << 56) - 1) for i in range(buckets)]
        return np.append(np.searchsorted(self.keys, np.asarray(edges, dtype=_U)), len(self.keys))

    def losses(self, rest_n: np.ndarray, rest_t: np.ndarray, totals: dict[str, int]) -> list[np.ndarray]:
        """Target and background loss of each document in nats a place; its own counts are taken out. NaN without words."""
        out = []
        least = min(totals["target"], totals["all"] - totals["target"])
        marked = self.target[self.doc]
        for side in (True, False):
            total, docs = (totals["target"], totals["target_docs"]) if side else (totals["all"] - totals["target"], totals["docs"] - totals["target_docs"])
            scale = least / total if least else 1.0  # matched: either model rests on as many words
            counts = self.t + rest_t if side else self.n + rest_n - self.t - rest_t
            mine = marked == side
            single, pair = (scale * (counts[at] - own * mine) for at, own in zip(self.at, self.own))
            history = np.empty(len(single))
            history[1:] = single[:-1]
            history[self.first] = scale * (docs - mine[self.first])
            own_size = np.bincount(self.doc, minlength=len(self.target))[self.doc] * mine
            p = (single + BACKOFF * UNIFORM) / (scale * (total - own_size) + BACKOFF)
            p = (pair + BACKOFF * p) / (history + BACKOFF)
            with np.errstate(invalid="ignore"):
                out.append(-np.bincount(self.doc, np.log(p), len(self.target)) / np.bincount(self.doc, minlength=len(self.target)))
        return out


def _grams(row: dict) -> Grams:
    return Grams(np.asarray(row["lengths"], dtype=np.int64), row["vocabulary"], row["words"], row["size"], row["targets"] or [])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, target, n_words, target_loss, background_loss, difference) of every whole text.

    The target is what ``labels`` marks with quality 1 (any label of a doc_id counts), the background all other
    documents. difference = target_loss - background_loss in nats a word, a text's end counting as one: the lower, the
    more like the target. Without words losses and difference are null. Repeated rows come out repeated; null ids are
    background; an empty table gives no rows; extra columns are ignored. A document's own counts are taken out of the
    model it was counted in, so that none is liked for being known.

    All words and pairs of the corpus are counted. A batch of documents asks for each of its n-grams once, in the
    bucket of the n-gram; the bucket adds up what all batches hold and answers each. So the most frequent n-gram is one row
    a batch, a task holds a batch or a bucket, whatever the input, and only five sums reach the driver.
    """
    own = batches(docs)
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct()
    each = own.select("batch", F.posexplode(F.arrays_zip("ids", "lengths")).alias("at", "row")).select("batch", "at", F.col("row.ids").alias("id"), F.col("row.lengths").alias("n"))
    held = F.when(F.col("n") > 0, F.col("n") + 1).otherwise(0)
    flags = written(each.join(good, "id").groupBy("batch").agg(F.collect_list("at").alias("targets"), F.sum(held).alias("target"), F.count_if(F.col("n") > 0).alias("target_docs")), "targets")
    worded = F.filter("lengths", lambda n: n > 0)
    totals = own.agg(F.sum(F.col("size") + F.size(worded)).alias("all"), F.sum(F.size(worded)).alias("docs")).first().asDict()
    totals |= flags.agg(F.sum("target").alias("target"), F.sum("target_docs").alias("target_docs")).first().asDict()
    totals = {k: int(v or 0) for k, v in totals.items()}
    buckets = max(1, -(-totals["all"] // BUCKET))

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for i in range(len(part)):
                row = part.slice(i, 1).to_pylist()[0]
                g = _grams(row)
                cuts, out = g.cuts(buckets), []
                for b, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    if y > x:
                        out.append((b, row["batch"], int(y - x), squeezed(np.diff(g.keys[x:y], prepend=_U(0))), squeezed(g.n[x:y]), squeezed(g.t[x:y])))
                if out:
                    kind = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kind)], ["bucket", "batch", "size", "keys", "n", "t"])

    def answer(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        keys = np.concatenate([np.cumsum(spread(r["keys"], r["size"]), dtype=_U) for r in rows])
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        rest = {}
        for c in ("n", "t"):
            mine = np.concatenate([spread(r[c], r["size"]) for r in rows]).astype(np.int64)
            rest[c] = np.bincount(group, mine).astype(np.int64)[group] - mine
        ends = np.cumsum([r["size"] for r in rows])
        parts = [{c: squeezed(x[end - r["size"] : end]) for c, x in rest.items()} for r, end in zip(rows, ends)]
        kind = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = [r["batch"] for r in rows], [r["bucket"] for r in rows], [r["size"] for r in rows], [p["n"] for p in parts], [p["t"] for p in parts]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kind)], ["batch", "bucket", "size", "n", "t"])

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for i in range(len(part)):
                row = part.slice(i, 1).to_pylist()[0]
                g = _grams(row)
                rest = [np.concatenate([np.zeros(0, np.int64), *(spread(a[c], a["size"]).astype(np.int64) for a in sorted(row["answers"] or [], key=lambda a: a["bucket"]))]) for c in ("n", "t")]
                target, background = g.losses(*rest, totals)
                losses = [pa.array(x, pa.float64(), mask=np.asarray(row["lengths"]) == 0) for x in (target, background, target - background)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(g.target), pa.array(row["lengths"], pa.int64()), *losses], ["doc_id", "target", "n_words", "target_loss", "background_loss", "difference"])

    marked = own.join(flags.select("batch", "targets"), "batch", "left")
    asked = marked.mapInArrow(ask, "bucket long, batch long, size long, keys binary, n binary, t binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "batch long, bucket long, size long, n binary, t binary")
    answers = answered.groupBy("batch").agg(F.collect_list(F.struct("bucket", "size", "n", "t")).alias("answers"))
    return marked.join(answers, "batch", "left").mapInArrow(score, "doc_id long, target boolean, n_words long, target_loss double, background_loss double, difference double")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
