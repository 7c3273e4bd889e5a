"""Toxicity by nearest labelled examples: TF-IDF cosine over all their words, by a block-max inverted index, weighted votes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import claim, table

#: Labelled rows of each class the classifier is fitted on, at most.
SAMPLE = 2_000
#: Standard deviations by which a word must be oftener in toxic examples than chance has it before it weighs more than others, the weight
#: that each further one adds, and that of all other words. No word has the weight 0.
CHANCE, STEP, FLOOR = 3.0, 0.1, 0.02
NEIGHBOURS = 15
#: What the prior counts beside votes that weigh as their similarity.
PRIOR_VOTE = 0.01
#: Examples in a block of the index.
BLOCK = 32
#: Blocks scored before any is ruled out.
FIRST = 4
#: A term that one in so many examples has is common.
COMMON = 8
THRESHOLD = 0.7
#: Words whose numbers a worker keeps.
WORDS = 150_000
#: Characters of texts whose words are numbered before they are searched for.
TOGETHER = 800_000

_TERM = re.compile(r"\w+")
_NONE = np.zeros(0, dtype=np.int64)


def word_counts(text: str | None) -> Counter[str]:
    """How often each word, in lower case, stands in the whole text; a null text has none."""
    return Counter(_TERM.findall((text or "").lower()))


def word_hash(word: str) -> int:
    """The 63 bits a word is known by."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


def _together(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in lists of ``TOGETHER`` characters, or a longer text after others that have fewer."""
    some, n = [], 0
    for text in texts:
        some.append(text)
        n += len(text or "") + 1
        if n >= TOGETHER:
            yield some
            some, n = [], 0
    if some:
        yield some


def _numbered(words: Collection[str], numbers: dict[str, int], vocabulary: np.ndarray) -> np.ndarray:
    """The place of each different word in ``vocabulary``, sorted hashes, or -1; ``numbers`` keeps at most ``WORDS`` places, or those new in one text.

    Kept words are looked up once; a table of that many is far larger than a processor's cache.
    """
    found = list(map(numbers.get, words))
    if None in found:
        new = [w for w, n in zip(words, found) if n is None]
        hashes = np.fromiter(map(word_hash, new), dtype=np.int64, count=len(new))
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        own = np.where(vocabulary[at] == hashes, at, -1).tolist()
        if len(numbers) + len(new) > WORDS:
            numbers.clear()
        numbers.update(zip(new, own))
        rest = iter(own)
        found = [next(rest) if n is None else n for n in found]
    return np.array(found, dtype=np.int64)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all given spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _summed(rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The sum of the rows, each times its weight, row by row, so that equal columns have equal sums; changes ``rows``."""
    rows *= weight
    return np.add.reduce(rows, axis=0)


class BlockMaxIndex:
    """Postings of unit vectors; of each common term and block of examples the largest weight is known.

    ``nearest`` is exact: the blocks of largest bounds are scored first, and others only if their bound
    reaches the k-th best similarity found there. Ties go to the smaller number. Terms of one in ``COMMON``
    examples or more have most postings of a query; their weights lie in rows by block, zeros included
    (at most ``COMMON`` times their postings), and only those of scored blocks are read. The postings of other
    terms are summed at once, which is less work than their bounds; a block's bound is its largest such sum
    and the largest weights of the common terms.
    """

    def __init__(self, vectors: list[dict[int, float]]):
        self.size, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        lengths = [len(v) for v in vectors]
        term = np.fromiter((t for v in vectors for t in v), dtype=np.int64, count=sum(lengths))
        weight = np.fromiter((w for v in vectors for w in v.values()), dtype=np.float64, count=sum(lengths))
        example = np.repeat(np.arange(self.size), lengths)
        order = np.lexsort((example, term))
        term, self.weight, self.example = term[order], weight[order], example[order]
        self.start = np.searchsorted(term, np.arange(term[-1] + 2 if len(term) else 1))
        self.count = np.diff(self.start)
        common = np.flatnonzero(self.count * COMMON >= max(1, self.size))
        self.row = np.full(len(self.count), -1, dtype=np.int32)
        self.row[common] = np.arange(len(common))
        at = _spans(self.start[common], self.count[common])
        #: Of each common term and block: the weights in its examples, and the largest.
        self.weights = np.zeros((len(common), self.blocks * BLOCK))
        self.weights[np.repeat(np.arange(len(common)), self.count[common]), self.example[at]] = self.weight[at]
        self.weights = self.weights.reshape(len(common), self.blocks, BLOCK)
        self.most = self.weights.max(axis=2)

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k most similar examples with a similarity above 0, as (similarity, example), best first."""
        terms = np.fromiter(query, dtype=np.int64, count=len(query))
        return self.nearest_of(terms, np.fromiter(query.values(), dtype=np.float64, count=len(query)), k)

    def nearest_of(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """As ``nearest``, of a query as arrays of its terms and their weights."""
        known = (terms >= 0) & (terms < len(self.count))
        terms, weights = terms[known], weights[known]
        if not len(terms):
            return []
        row = self.row[terms]
        common, rare = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        row, weight = row[common], weights[common][:, None]
        count = self.count[terms[rare]]
        at = _spans(self.start[terms[rare]], count)
        sums = np.bincount(self.example[at], weights=self.weight[at] * np.repeat(weights[rare], count), minlength=self.blocks * BLOCK).reshape(-1, BLOCK)
        bounds = sums.max(axis=1) + _summed(self.most[row], weight)

        def score(chosen: np.ndarray) -> np.ndarray:
            return sums[chosen].ravel() + _summed(self.weights[row[:, None], chosen].reshape(len(row), len(chosen) * BLOCK), weight)

        chosen = np.argpartition(-bounds, FIRST)[:FIRST] if self.blocks > FIRST else np.arange(self.blocks)
        scores = score(chosen)
        least = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
        more = bounds >= max(least - 1e-9, 1e-12)
        more[chosen] = False
        if more.any():
            others = np.flatnonzero(more)
            chosen, scores = np.append(chosen, others), np.append(scores, score(others))
        found = np.flatnonzero(scores >= max(least, 1e-300))
        example, scores = chosen[found // BLOCK] * BLOCK + found % BLOCK, scores[found]
        best = np.lexsort((example, -scores))[:k]
        return list(zip(scores[best].tolist(), example[best].tolist()))


class Model:
    """The index of labelled examples, the weights of all their words, and the share of toxic ones among all labelled.

    A word weighs its inverse document frequency times its lean: ``FLOOR``, and ``STEP`` for each standard deviation beyond
    ``CHANCE`` by which more toxic examples hold it than chance has it. A vector holds all words that any example has; others
    can meet none, and are left out of a query's length too.
    """

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], prior: float):
        self.vocabulary, self.weight, self.prior = vocabulary, weight, prior
        self.words: dict[str, int] = {}
        held = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *(e[2] for e in examples)]), minlength=len(vocabulary))
        rows = []
        for doc_id, label, own, counts in examples:
            terms, weights = self.vector(own, counts)
            if len(terms):
                rows.append((label, int(terms[np.argmax(weights * held[terms])]), doc_id, dict(zip(terms.tolist(), weights.tolist()))))
        rows.sort(key=lambda r: r[:3])  # examples of one class that share their main word share blocks
        self.ids, self.labels = [r[2] for r in rows], [r[0] for r in rows]
        self.index = BlockMaxIndex([r[3] for r in rows])

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms, by number, and their weights in the unit vector of a text with so many of each."""
        raw = (1 + np.log(counts)) * self.weight[terms]
        return terms, raw / math.sqrt(float(raw @ raw)) if len(raw) else raw

    def query(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ``vector`` of a text, of all its words that an example has."""
        counts = word_counts(text)
        terms = _numbered(counts, self.words, self.vocabulary)
        known = terms >= 0
        return self.vector(terms[known], np.fromiter(counts.values(), dtype=np.float64, count=len(counts))[known])

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        """A score from 0 to 1 and its evidence: (similarity, doc_id) of the nearest examples.

        Votes weigh as their similarity, the prior as ``PRIOR_VOTE``. A text without words that an example has gets the prior.
        """
        return next(self.scores([text]))

    def scores(self, texts: Iterable[str | None]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """The ``score`` of each text. Words of texts of ``TOGETHER`` characters are numbered before the first is searched for, so words and index don't drive each other from the cache."""
        for some in _together(texts):
            for terms, weights in [self.query(t) for t in some] if len(self.vocabulary) else [(_NONE, _NONE)] * len(some):
                near = self.index.nearest_of(terms, weights, NEIGHBOURS)
                toxic = sum(s for s, i in near if self.labels[i])
                found = (toxic + PRIOR_VOTE * self.prior) / (sum(s for s, _ in near) + PRIOR_VOTE)
                yield min(1.0, max(0.0, found)) if near else self.prior, [(s, self.ids[i]) for s, i in near]


def training_rows(labels: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[int, int]], float]:
    """(doc_id, toxic) of at most ``sample`` rows a class to learn from, and the share of toxic ones among all of them.

    Rows whose crc32(doc_id) mod 3 is 1, and null ids or labels, are left out. A document with several
    labels is toxic if any says so. The rows with the smallest hashes are taken, so any run takes the same.
    """
    kept = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND crc32(cast(doc_id AS string)) % 3 <> 1")
    one = kept.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    rows = [(r["doc_id"], c) for c in (0, 1) for r in one.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    return rows, count.get(1, 0) / max(1, sum(count.values()))


def _examples(docs: DataFrame, rows: list[tuple[int, int]]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(doc_id, toxic, word hashes, counts) of the whole texts of the chosen rows; of several texts of a doc_id the smallest."""
    chosen = F.broadcast(docs.sparkSession.createDataFrame(rows, "doc_id long, toxic int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [word_counts(t.as_py()) for t in batch.column(2)]
            words = [np.fromiter(map(word_hash, c), dtype=np.int64, count=len(c)).tobytes() for c in own]
            counts = [np.fromiter(c.values(), dtype=np.int32, count=len(c)).tobytes() for c in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "toxic", "words", "counts"])

    found = texts.mapInArrow(counted, "doc_id long, toxic int, words binary, counts binary").orderBy("doc_id").collect()
    return [(r["doc_id"], r["toxic"], np.frombuffer(r["words"], dtype=np.int64), np.frombuffer(r["counts"], dtype=np.int32)) for r in found]


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each word of ``vocabulary``, sorted hashes, stands, and how many documents there are.

    A task keeps one counter a word of the vocabulary and sends those above 0 once, whatever its rows; words are counted as they
    are, and hashed and looked up once for every ``WORDS`` distinct ones.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = np.zeros(len(known), dtype=np.int64)
        held: Counter[str] = Counter()
        claim("toxicity", held.clear)

        def settle() -> None:
            hashes = np.fromiter(map(word_hash, held), dtype=np.int64, count=len(held))
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            np.add.at(total, at[hit], np.fromiter(held.values(), dtype=np.int64, count=len(held))[hit])
            held.clear()

        for batch in batches:
            for text in batch.column(0):
                held.update(set(_TERM.findall((text.as_py() or "").lower())))
                if len(held) > WORDS:
                    settle()
        settle()
        at = np.flatnonzero(total)
        for start in range(0, len(at), 65_536):
            part = at[start : start + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), dtype=np.int64)
    out[counts.column("word").to_numpy()] = counts.column("n").to_numpy()
    return out, docs.count()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the whole texts of ``training_rows``, with document frequencies from all of ``docs``; without any, every score is the prior 0."""
    rows, prior = training_rows(labels, sample)
    examples = _examples(docs, rows) if rows else []
    if not any(len(words) for _, _, words, _ in examples):
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), [], prior)
    vocabulary = np.unique(np.concatenate([e[2] for e in examples]))
    numbered = [(doc_id, toxic, np.searchsorted(vocabulary, words), counts.astype(np.float64)) for doc_id, toxic, words, counts in examples]
    held = lambda chosen: np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *chosen]), minlength=len(vocabulary))
    every, toxic = held([e[2] for e in numbered]), held([e[2] for e in numbered if e[1]])
    share = sum(e[1] for e in numbered) / len(numbered)
    deviations = (toxic - every * share) / np.sqrt(np.maximum(every * share * (1 - share), 1e-9))
    n, total = document_frequencies(docs, vocabulary)
    idf = np.log((total + 1) / (np.maximum(n, 1) + 1)) + 1
    return Model(vocabulary, idf * (FLOOR + STEP * np.maximum(deviations - CHANCE, 0)), numbered, prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence array<struct<similarity, doc_id>>) of every whole text.

    Null and empty texts get the prior and no evidence; repeated rows come out repeated, an empty
    table gives no rows, extra columns are ignored. Only texts are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shape = pa.list_(pa.struct([("similarity", pa.float64()), ("doc_id", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sent.value.scores(t.as_py() for t in batch.column(1)))
            evidence = [[{"similarity": s, "doc_id": i} for s, i in e] for _, e in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(evidence, shape)], ["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<similarity:double,doc_id:long>>")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their columns; text isn't shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score < threshold for score, _ in sent.value.scores(t.as_py() for t in batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
