"""Best-fit packing of token pieces into sequences by bin completion, branch and bound over lengths."""

from __future__ import annotations

import random
import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import claim, ranked, table, written

#: Distinct words a worker keeps ids of, before it starts anew.
WORDS = 150_000
#: Fillings the branch and bound may look at after its first dive; beyond them the best packing so far stands.
STEPS = 60_000
#: Of these, the most that one search over a few bins takes.
REPACK = 200
#: Frames of a search that keep the sums they reach.
KEPT = 32

#: Texts of these characters only have one reading of letters, case and white space in every library.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")
#: Of such texts in lower case, the parts that are merged apart from each other.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
#: The letter that byte-level vocabularies write for each byte: itself where Latin-1 prints it, else the next from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b if b in _PRINTED else 256 + b - sum(x < b for x in _PRINTED)) for b in range(256)}


class WordIds(dict):
    """Word to its ids as little-endian bytes. No token reaches over white space, so plain texts go word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if word.isalpha():
                if not word.isascii():
                    word_bytes = "".join(map(_BYTES.__getitem__, word.encode()))
                else:
                    word_bytes = word
                found = array("I", [x.id for x in self.tokenizer.model.tokenize(word_bytes)]).tobytes()
            else:
                parts = _WORD.findall(word)
                found = b"".join(map(self.__getitem__, parts)) if parts != [word] else self.ids(word)
        if len(self) >= WORDS:
            self.old = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return self.ids(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


_tables: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _tables:
        _tables[path] = WordIds(path)
    claim("packing", _tables.clear)
    return _tables[path]


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and ``end_id``, cut at ``limit``.

    A null or empty text is the one id ``end_id``. Repeated rows give their pieces again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, step = word_ids(tokenizer), np.asarray([end_id], dtype="<u4").tobytes(), 4 * limit
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def least_bins(counts: np.ndarray) -> int:
    """A lower bound on bins (Martello and Toth's L2); counts[l] items of length l, len(counts) - 1 the capacity."""
    cap = len(counts) - 1
    number, size = np.cumsum(counts), np.cumsum(counts * np.arange(cap + 1))
    best = -(-int(size[-1]) // cap)
    a = np.arange(1, cap // 2 + 1)
    if len(a):
        large, middle_n = number[-1] - number[cap - a], number[cap - a] - number[cap // 2]
        spare = middle_n * cap - (size[cap - a] - size[cap // 2])
        small = size[cap // 2] - size[a - 1]
        best = max(best, int((large + middle_n + np.maximum(0, -((spare - small) // cap))).max()))
    return best


def smeared(bits: int, by: int) -> int:
    """The set bits, each with the ``by`` places above it."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


def dominated(way: tuple[int, ...], room: int, counts: np.ndarray) -> bool:
    """Whether an item left out could take the place of some of ``way``, or of nothing, without lack of room.

    The test of bin completion: the item is larger than the one it replaces, or at least as large as several together.
    """
    waste, one, more, spare = room - sum(way), 0, 0, 0
    for x in way:
        more |= (one | more) << x
        one |= 1 << x
    used = dict.fromkeys(way, 0)
    for x in way:
        used[x] += 1
    most = max(room, 1)
    for x in np.flatnonzero(counts[: most + 1]).tolist():
        if counts[x] > used.get(x, 0):
            spare |= 1 << x
    single = (smeared(1 | one, waste - 1) << 1) if waste else 0
    return bool((single | smeared(more, waste)) & spare)


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated ways to fill ``room`` from ``counts``, one by one, least waste first; None for each dominated one met.

    Ways of one sum come with larger items first. Sums that the i smallest lengths reach are kept as
    bits, so no step leads to a dead end. A single item that fits exactly dominates all else.
    """
    have = np.flatnonzero(counts[: room + 1]).tolist()
    if not have:
        yield ()
        return
    if have[-1] == room:
        yield (room,)
        return
    number = [min(int(counts[x]), room // x) for x in have]
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x, n in zip(have, number):
        sums, block = reach[-1], 1
        while n:
            taken = min(block, n)
            sums |= sums << (taken * x)
            n, block = n - taken, 2 * block
        reach.append(sums & mask)

    def exact(top: int, rest: int, way: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield way
            return
        for i in range(min(top, bisect_right(have, rest)) - 1, -1, -1):
            if not reach[i + 1] >> rest & 1:
                return
            x = have[i]
            for n in range(min(number[i], rest // x), 0, -1):
                if reach[i] >> (rest - n * x) & 1:
                    yield from exact(i, rest - n * x, (*way, *[x] * n))

    for waste in range(room - have[0] + 1):  # to waste more than that is to leave out an item that fits
        if reach[-1] >> (room - waste) & 1:
            for way in exact(len(have), room - waste, ()):
                yield None if dominated(way, room, counts) else way


class Budget:
    """Fillings the search may still look at."""

    def __init__(self, steps: int):
        self.left = steps


def completions(counts: np.ndarray, bins: int, budget: Budget) -> Iterator[list[tuple[int, tuple[int, ...]]]]:
    """Packings of ``counts`` into at most ``bins`` bins, depth first: (times, lengths of one bin).

    The largest item left is completed by each of its undominated fillings, as many times as the counts
    allow; what wastes more than ``bins`` leave, what its lower bound forbids and what was met before is cut.
    The first dive looks at one undominated filling a node and isn't bound by the budget.
    """
    cap, spare = len(counts) - 1, bins * (len(counts) - 1) - int((counts * np.arange(len(counts))).sum())
    if spare < 0:
        return

    def ways_of(left: np.ndarray, skip: int = 0) -> Iterator[tuple[int, ...] | None]:
        top = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[top] -= 1
        return islice(((top, *way) if way is not None else None for way in fillings(rest, cap - top)), skip, None)

    # without recursion: a frame holds what is left, bins and waste so far, its own bin, its ways and how many were looked at
    frames: list[list] = [[counts, 0, 0, None, ways_of(counts), 0]]
    met: set[int] = set()
    dived = False
    while frames and (budget.left > 0 or not dived):
        frame = frames[-1]
        if frame[4] is None:
            frame[4] = ways_of(frame[0], frame[5])
        way = next(frame[4], 0)
        if way == 0 or way is not None and frame[2] + cap - sum(way) > spare:
            dived = True
            frames.pop()  # ways come least waste first, so none after this one fits either
            continue
        frame[5] += 1
        budget.left -= 1
        if way is None:
            continue
        rest = frame[0].copy()
        need = Counter(way)
        times = min(int(rest[x]) // n for x, n in need.items())
        while times and frame[2] + times * (cap - sum(way)) > spare:
            times -= 1
        for x, n in need.items():
            rest[x] -= n * times
        used, lost = frame[1] + times, frame[2] + times * (cap - sum(way))
        if not rest.any():
            dived = True
            yield [*(f[3] for f in frames if f[3]), (times, way)]
            continue
        known = hash(rest.tobytes())
        if known in met or used + least_bins(rest) > bins:
            continue
        met.add(known)
        frames.append([rest, used, lost, (times, way), ways_of(rest), 0])
        if len(frames) > KEPT:  # a frame far above gives up its sums; it makes them anew when the search comes back
            frames[-KEPT - 1][4] = None


def best_fit(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over counts: (times, lengths of one bin)."""
    out, left = [], counts.copy()
    while left.any():
        way, room, spare = [], len(counts) - 1, left.copy()
        while len(fit := np.flatnonzero(spare[: room + 1])):
            way.append(int(fit[-1]))
            spare[fit[-1]] -= 1
            room -= int(fit[-1])
        need = Counter(way)
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        out.append((times, tuple(way)))
    return out


def repacked(best: Counter, cap: int, bound: int, budget: Budget) -> Counter:
    """Better packings by bin completion of a few bins at a time: bins with waste and others, chosen by a fixed sequence.

    Up to four of each are taken. Their items are searched for a bin less, or else for as many bins with the waste gathered in fewer
    of them; equal ones are taken too, so the search moves on. Ends at ``bound`` or with the budget.
    """
    draw = random.Random(0)
    while best.total() > bound and budget.left > 0:
        budget.left -= 1
        ways = list(best)
        loose = [way for way in ways if sum(way) < cap]
        chosen: Counter = Counter()
        for way in draw.sample(loose, min(len(loose), draw.randint(1, 4))) + draw.sample(ways, min(len(ways), draw.randint(1, 4))):
            if chosen[way] < best[way]:
                chosen[way] += 1
        counts = np.zeros(cap + 1, dtype=np.int64)
        for way, times in chosen.items():
            for x in way:
                counts[x] += times
        items, bins = int((counts * np.arange(cap + 1)).sum()), chosen.total()
        fewer = bins - 1 if items <= (bins - 1) * cap else bins
        own = Budget(min(REPACK, budget.left))
        start, order = own.left, sum(times * sum(way) ** 2 for way, times in chosen.items())
        for found in (p for target in dict.fromkeys((fewer, bins)) for p in completions(counts, target, own)):
            now: Counter = Counter()
            for times, way in found:
                now[tuple(sorted(way, reverse=True))] += times
            if now.total() < bins or now != chosen and sum(times * sum(way) ** 2 for way, times in now.items()) >= order:
                best = best - chosen + now
                break
        budget.left -= start - own.left
    return best


def pack_lengths(counts: np.ndarray, steps: int = STEPS) -> list[tuple[int, tuple[int, ...]]]:
    """Packs counts[l] items of length l into bins of len(counts) - 1: (times, lengths of one bin).

    Best-fit decreasing gives the first incumbent, branch and bound over undominated fillings the next
    ones; half of ``steps`` goes to the whole search, half to searches over a few bins of the incumbent.
    """
    counts = counts.astype(np.int64)
    if not counts.any():
        return []
    best, bound = best_fit(counts), least_bins(counts)
    budget = Budget(steps // 2)
    while (bins := sum(times for times, _ in best)) > bound:
        found = next(completions(counts, bins - 1, budget), None)
        if found is None:
            break
        best = found
    if bins > bound:
        whole: Counter = Counter()
        for times, way in best:
            whole[tuple(sorted(way, reverse=True))] += times
        best = [(times, way) for way, times in repacked(whole, len(counts) - 1, bound, Budget(steps - steps // 2)).items()]
    return best


def pack(pieces: DataFrame, limit: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``; ``pieces`` should be a written table with a length of 1 to ``limit``.

    Items of one length are alike, so the search runs over the counts of lengths: at most ``limit``
    numbers, whatever the input. Pieces then take the places of their length by their rank in it.
    """
    counts = np.zeros(limit + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken, first = [0] * (limit + 1), 0
    for times, way in pack_lengths(counts):
        offset = 0
        for length in way:
            slots.setdefault(length, []).append((taken[length], first, offset))
            taken[length] += times
            offset += length
        first += times
    places = {length: np.asarray(rows, dtype=np.int64).T for length, rows in slots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                start, seq, off = places[int(x)]
                at = np.searchsorted(start, rank[own], side="right") - 1
                sequence[own] = seq[at] + rank[own] - start[at]
                offset[own] = off[at]
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    placed = ranked(pieces, ["length"], ["doc_id", "piece"], "_rank", "ranks").select(*pieces.columns, "_rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return placed.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 4096) -> DataFrame:
    """Whole documents packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents over ``limit`` ids are cut. Null and empty texts hold one place. Repeated rows
    hold a place each. An empty table gives no rows. Extra columns are ignored.
    """
    return pack(written(token_pieces(docs, tokenizer, limit), "pieces"), limit)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096)
