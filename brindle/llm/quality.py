"""Quality by nearest labelled neighbours: latent-semantic vectors of words and their shapes, exact blocked cosine, votes weighted by similarity."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import claim, table

#: Labelled rows of each class the classifier is fitted on, at most.
SAMPLE = 1_500
#: Numbers that terms are hashed to; with RANK latent components they bound what is broadcast.
TERMS, RANK = 1 << 16, 64
NEIGHBOURS = 25
#: A vote weighs its similarity to this power; the prior counts as much as one vote of this weight.
POWER, PRIOR_VOTE = 8, 1e-4
#: Documents that meet all examples in one product.
ROWS = 256
#: Columns of the term matrix the fit holds as a dense block.
COLUMNS = 4_096
THRESHOLD = 0.5
#: Words whose terms a worker keeps.
WORDS = 150_000

#: What a byte is in an outline: a capital, another letter or part of one, a digit, or itself.
_OUTLINE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
_SAME = re.compile(rb"(.)\1+", re.DOTALL)


def term(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) % TERMS


def outline(word: bytes) -> bytes:
    """A word's outline: A for capitals of ASCII, a for other letters, 9 for digits, other characters themselves; repeats once."""
    return _SAME.sub(rb"\1", word.translate(_OUTLINE))


class _Terms(dict):
    """Both terms of a word, itself and its outline, in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = term(b"w" + word) * TERMS + term(b"o" + outline(word))
        return found


_terms = _Terms()
#: Terms of the share of words that repeat the one before, and of lines that repeat an earlier one: one more each eighth begun.
_AGAIN, _LINES = (np.asarray([term(b"%b%d" % (kind, i)) for i in range(8)]) for kind in (b"again", b"line"))
_EMPTY = term(b"empty")


def counted(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a whole text and their counts: words, their outlines, and, as often as there are words, the eighths of repeats.

    Repeats are words that equal the one before and lines that equal an earlier one. A text without words has one term of its own.
    """
    words = (text or b"").split()
    if not words:
        return np.asarray([_EMPTY]), np.ones(1, dtype=np.int64)
    both = np.fromiter(map(_terms.__getitem__, words), dtype=np.int64, count=len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    again, repeated = int((both[1:] == both[:-1]).sum()), len(lines) - len(set(lines))
    eighths = np.concatenate([_AGAIN[: -(-8 * again // len(words))], _LINES[: -(-8 * repeated // len(lines))]])
    terms, counts = np.unique(np.concatenate([both // TERMS, both % TERMS, np.repeat(eighths, len(words))]), return_counts=True)
    return terms, counts


class Model:
    """The projection of terms to latent components, inverse document frequencies, and the examples' unit vectors and labels.

    All of it is of a size that the constants bound, whatever the corpus.
    """

    def __init__(self, idf: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], prior: float):
        self.idf, self.labels, self.prior = idf, np.asarray(labels, dtype=np.float64), prior
        rows = [(terms, self._weights(terms, counts)) for terms, counts in examples]
        if not rows:
            return
        gram = np.zeros((len(rows), len(rows)))
        for block in self._blocks(rows):
            gram += block @ block.T
        values, vectors = np.linalg.eigh(gram)
        keep = np.flatnonzero(values[::-1][:RANK] > 1e-9)
        values, vectors = values[::-1][keep], vectors[:, ::-1][:, keep]
        self.projection = np.concatenate([block.T @ (vectors / np.sqrt(values)) for block in self._blocks(rows)]).astype(np.float32)
        self.examples = self.latent(rows)

    @staticmethod
    def _blocks(rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        """The dense matrix of the examples' weights, some columns at a time."""
        for start in range(0, TERMS, COLUMNS):
            block = np.zeros((len(rows), COLUMNS), dtype=np.float32)
            for row, (terms, weights) in zip(block, rows):
                first, last = np.searchsorted(terms, (start, start + COLUMNS))
                row[terms[first:last] - start] = weights[first:last]
            yield block

    def _weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        raw = (1 + np.log(counts)) * self.idf[terms]
        return (raw / np.sqrt(raw @ raw)).astype(np.float32)

    def latent(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit latent vectors of rows of (terms, weights); zero where no example has a term of the row."""
        out = np.stack([weights @ self.projection[terms] for terms, weights in rows])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """The share of label 1 among the nearest examples' votes, each by its similarity; a text near no example gets the prior."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        near = self.latent([(terms, self._weights(terms, counts)) for terms, counts in map(counted, texts)]) @ self.examples.T
        if near.shape[1] > NEIGHBOURS:
            best = np.argpartition(-near, NEIGHBOURS, axis=1)[:, :NEIGHBOURS]
            near, labels = np.take_along_axis(near, best, axis=1), self.labels[best]
        else:
            labels = np.broadcast_to(self.labels, near.shape)
        votes = np.maximum(near, 0).astype(float) ** POWER
        return ((votes * labels).sum(axis=1) + PRIOR_VOTE * self.prior) / (votes.sum(axis=1) + PRIOR_VOTE)


def training_rows(labels: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[int, int]], float]:
    """(doc_id, quality) of at most ``sample`` rows a class to learn from, and the share of label 1 among all of them.

    Rows whose crc32(doc_id) mod 3 is 1, and null ids or labels, are left out. A document with several labels
    has the smallest. The rows with the smallest hashes are taken, so any run takes the same.
    """
    kept = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND crc32(cast(doc_id AS string)) % 3 <> 1")
    one = kept.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    count = {r["quality"]: r["count"] for r in one.groupBy("quality").count().collect()}
    rows = [(r["doc_id"], c) for c in (0, 1) for r in one.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    return rows, count.get(1, 0) / max(1, count.get(0, 0) + count.get(1, 0))


def _examples(docs: DataFrame, rows: list[tuple[int, int]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """Terms and counts of the chosen rows' whole texts, and their labels; of several texts of a doc_id the smallest."""
    chosen = F.broadcast(docs.sparkSession.createDataFrame(rows, "doc_id long, quality int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", _terms.clear)
        for batch in batches:
            own = [counted(t.as_py()) for t in batch.column(2).cast(pa.binary())]
            data = [pa.array([x[i].astype("<i4").tobytes() for x in own], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *data], ["doc_id", "quality", "terms", "counts"])

    found = texts.mapInArrow(run, "doc_id long, quality int, terms binary, counts binary").orderBy("doc_id").collect()
    return [(np.frombuffer(r["terms"], dtype="<i4"), np.frombuffer(r["counts"], dtype="<i4")) for r in found], [r["quality"] for r in found]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each term stands, and how many documents there are; a task sends each of its terms once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", _terms.clear)
        total, rows = np.zeros(TERMS + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                total[counted(text.as_py())[0]] += 1
            rows += batch.num_rows
        total[TERMS] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TERMS + 1, dtype=np.int64)
    out[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    return out[:TERMS], int(out[TERMS])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the whole texts of ``training_rows``, with document frequencies of all of ``docs``; without any, every score is the prior, 0 without labels."""
    rows, prior = training_rows(labels, sample)
    examples, marks = _examples(docs, rows) if rows else ([], [])
    if not examples:
        return Model(np.zeros(TERMS), [], [], prior)
    n, total = document_frequencies(docs)
    return Model(np.log((total + 1) / (n + 1)) + 1, examples, marks, prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text, from its text alone.

    Null, empty and blank texts share one term and are scored by it. Repeated rows come out repeated, a null doc_id stays
    null, an empty table gives no rows, extra columns are ignored. Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", _terms.clear)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = [t.as_py() for t in batch.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(texts), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
