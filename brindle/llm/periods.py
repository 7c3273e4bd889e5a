"""Runs of periodic words: aligned power-of-two blocks, searched across the document by an automaton, seed exact extension both ways."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 6, 4
#: Blocks that one automaton holds; the next ones go to another, so neither its root nor its memory grows with the document.
KEYS = 4_096
#: Words that are compared at once when a seed is extended, at first.
FIRST = 32
#: A block of so many periods of a run is known by that run.
SELF = 8

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periods_of(size: int) -> tuple[int, int]:
    """The least and the largest period that blocks of ``size`` words seed.

    A run of period q and at least 4q words holds an aligned block and that block again q words on, if the block has at most
    (3q + 1) / 2 words: a stretch of 2 * size - 1 words holds an aligned block. Of the sizes that fit, a period takes
    the largest, so each period has one size.
    """
    return -(-(2 * size - 1) // 3), (4 * size - 2) // 3


def common_length(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on, a < b, in the direction of ``step`` (1 or -1)."""
    most = len(words) - b if step > 0 else a + 1
    found, width = 0, FIRST
    while found < most:
        width = min(width, most - found)
        if step > 0:
            same = words[a + found : a + found + width] == words[b + found : b + found + width]
        else:
            same = (words[a - found - width + 1 : a - found + 1] == words[b - found - width + 1 : b - found + 1])[::-1]
        if not same.all():
            return found + int(np.argmin(same))
        found += width
        width *= 2
    return found


def next_distance(words: np.ndarray) -> np.ndarray:
    """How far on each word stands again; the number of words for the last of its kind."""
    order = np.argsort(words, kind="stable")
    out = np.full(len(words), len(words), dtype=np.int64)
    again = words[order[1:]] == words[order[:-1]]
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def block_matches(words: np.ndarray, starts: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of a block, start of a later occurrence) for blocks of ``size`` words at ``starts``, aligned, within the periods of ``size``.

    An automaton over sequences of word numbers finds each block wherever it stands. Blocks of equal content are one key.
    """
    least, _ = periods_of(size)
    blocks, others = [], []
    for first in range(0, len(starts), KEYS):
        own = starts[first : first + KEYS]
        begin, end = int(own[0]), min(len(words), int(own[-1]) + size + reach)
        text = tuple(words[begin:end].tolist())
        keys: dict[tuple[int, ...], int] = {}
        number = np.full((end - begin) // size + 1, -1, dtype=np.int64)
        for at in (own - begin).tolist():
            number[at // size] = keys.setdefault(text[at : at + size], len(keys))
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, i in keys.items():
            found.add_word(key, i)
        found.make_automaton()
        hits = np.fromiter((x for hit in found.iter(text) for x in hit), dtype=np.int64).reshape(-1, 2)
        at = hits[:, 0] - size + 1
        block = (at - least) // size  # no two aligned blocks are within the span of distances
        fits = (block >= 0) & (at - block * size <= reach)
        at, block, key = at[fits], block[fits], hits[fits, 1]
        same = number[block] == key
        blocks.append(block[same] * size + begin)
        others.append(at[same] + begin)
    return np.concatenate(blocks), np.concatenate(others)


def may_extend(words: np.ndarray, block: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """Whether a seed can be part of a run: on one of its sides the run has at least (3q - 1) / 4 words more, three of which are looked at."""
    period = other - block
    right, left = np.ones(len(block), dtype=bool), np.ones(len(block), dtype=bool)
    for skip in (np.zeros_like(period), period // 4, period // 2):
        after, before = other + size + skip, block - 1 - skip
        right &= (after < len(words)) & (words[np.minimum(after, len(words) - 1)] == words[np.minimum(after - period, len(words) - 1)])
        left &= (before >= 0) & (words[np.maximum(before, 0)] == words[np.maximum(before, 0) + period])
    return right | left


def by_known(starts: np.ndarray, found: dict[tuple[int, int], int], size: int, reach: int) -> np.ndarray:
    """``starts`` without the blocks whose occurrences the runs of smaller periods tell.

    A block within a run and ``reach`` before its end seeds that run again only. A block of ``SELF`` periods of a run stands
    in runs of that period only, and ``run_seeds`` has what it seeds; in an automaton it would be slow, being like itself.
    """
    gone = np.zeros(len(starts), dtype=bool)
    for (start, end), period in found.items():
        if end - start >= size:
            last = end - size if SELF * period <= size else end - size - reach
            gone[np.searchsorted(starts, start) : max(0, np.searchsorted(starts, last, side="right"))] = True
    return starts[~gone]


def run_seeds(words: np.ndarray, found: dict[tuple[int, int], int], size: int) -> Iterator[tuple[int, int]]:
    """(start, distance) of seeds among blocks of ``SELF`` periods of a known run.

    A larger run that holds such a block holds an end of the known run too, and that end again a period on or back, where
    another run of the same smaller period ends. So the ends of those runs, paired, give the seeds.
    """
    least, reach = periods_of(size)
    known: dict[int, list[tuple[int, int]]] = {}
    for (start, end), period in found.items():
        if SELF * period <= size <= end - start:
            known.setdefault(period, []).append((start, end))
    for runs in known.values():
        for places in (sorted(start for start, _ in runs), sorted(end - size for _, end in runs)):
            for i, at in enumerate(places):
                for other in places[i + 1 :]:
                    if other - at > reach:
                        break
                    if other - at >= least and np.array_equal(words[at : at + size], words[other : other + size]):
                        yield at, other - at


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period.

    A run is a stretch with smallest period q of at least ``LEAST`` words and ``TIMES`` periods, which neither neighbouring word
    extends. Sizes go up, so what a size can find again of the runs of smaller periods is left out. Of several
    periods of one stretch the smallest is its own.
    """
    n = len(words)
    found: dict[tuple[int, int], int] = {}
    far = next_distance(words) if n >= LEAST else np.zeros(0, dtype=np.int64)
    size = 2
    while n >= LEAST and TIMES * periods_of(size)[0] <= n:
        _, reach = periods_of(size)
        count = n // size
        # a block can stand again within reach only if each of its words does
        starts = np.flatnonzero((far[: count * size] <= reach).reshape(count, size).all(axis=1)) * size
        seeds = set(run_seeds(words, found, size)) if found else set()
        if len(starts) and found:
            starts = by_known(starts, found, size, reach)
        if len(starts):
            block, other = block_matches(words, starts, size, reach)
            keep = may_extend(words, block, other, size)
            seeds.update(zip(block[keep].tolist(), (other - block)[keep].tolist()))
        done, until = 0, 0  # the period and the end of the stretch extended last
        for at, q in sorted(seeds, key=lambda seed: seed[::-1]):
            if q == done and at + q + size <= until:
                continue
            start = at - common_length(words, at - 1, at + q - 1, -1)
            until, done = at + q + size + common_length(words, at + size, at + q + size, 1), q
            if until - start >= max(LEAST, TIMES * q):
                found[start, until] = min(q, found.get((start, until), q))
        size *= 2
    return sorted((start, end - start, q) for (start, end), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number, equal for equal words only."""
    number: dict[bytes, int] = {}
    return np.fromiter([number.setdefault(w, len(number)) for w in words], dtype=np.int64, count=len(words))


def periodic_runs(docs: DataFrame, altered: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) of every whole text.

    Words are parted by space and \\t to \\r. ``collapsed`` is the text with each run cut to its first period, words joined by one
    space. ``altered`` gives the words to look at in place of a document's own. A row is a task of its own: nothing
    is shuffled. Null, empty and blank texts have no words, no runs and an empty ``collapsed``; repeated rows come out
    repeated, a null doc_id stays null, an empty table gives no rows, extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, every, texts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if altered:
                    words = altered(doc_id, words)
                runs = find_runs(numbered(words))
                if runs:
                    texts.append(b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]))
                else:
                    texts.append(b" ".join(words))
                counts.append(len(words))
                every.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(every, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, chosen by the checksum of their ids, repeat their words from one place on; a null id is never chosen."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    again = words[at : at + period]
    return words[:at] + (again * -(-(n - at) // period))[: n - at]


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), looped)
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.withColumn("first", F.array_min(order))
    length, period = -F.col("first.less"), F.col("first.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("first.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
