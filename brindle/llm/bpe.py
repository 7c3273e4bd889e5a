"""Byte-level BPE by prefix dynamic programming: each byte prefix has one valid last token."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import claim, table

#: Entries a worker keeps of chunks, prefixes and token pairs, before it starts anew.
PIECES = 250_000
_NEVER = 1 << 60

#: White space beside a space, and a space between two characters that aren't white space.
_SPACES, _CUT = regex.compile(r"\s \s?| \s|^ | $"), regex.compile(r"(?<=\S) (?=\S)")


class PrefixEncoder:
    """Encodes bytes so that appends and edits cost no more than what they touch.

    Each byte prefix has one valid last token: a suffix token is valid if the last token of the
    shorter prefix before it stays beside it when the two are encoded together. A last token
    depends on its prefix alone, so words that begin alike share their entries, an append only adds
    entries, and an edit keeps those before it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: The length of the longest token that ends in three bytes; where there is none, a last token has two at most.
        self.reach: dict[bytes, int] = {}
        for b in ranks:
            if len(b) > 2:
                self.reach[b[-3:]] = max(len(b), self.reach.get(b[-3:], 0))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.sides: dict[bytes, tuple[list, list] | None] = {}
        self.prefixes: dict[bytes, tuple[bytes, str]] = {}

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """Plain merging, lowest rank first: the definition the prefix table answers to."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            at, rank = -1, None
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (rank is None or r < rank):
                    at, rank = i, r
            if rank is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def grown(self, token: bytes) -> tuple[list, list] | None:
        """How the parts at a token's left and right edge grow, as (part, rank at which it is merged on);
        None if the bytes don't merge to the token."""
        if token in self.sides:
            return self.sides[token]
        parts, found = self.merged(token, 2), None
        if len(token) == 1:
            found = [(token, _NEVER)], [(token, _NEVER)]
        elif len(parts) == 2 and (a := self.grown(parts[0])) and (b := self.grown(parts[1])):
            rank = self.ranks[token]
            found = [*a[0][:-1], (parts[0], rank), (token, _NEVER)], [*b[1][:-1], (parts[1], rank), (token, _NEVER)]
        self.sides[token] = found
        return found

    def adjacent(self, left: bytes, right: bytes) -> bool:
        """Whether the encoding of left + right is [left, right].

        Both tokens are merged up step by step, lowest rank first and on a tie the left one; they
        stay apart unless the two parts at the border would be merged before either grows.
        """
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= PIECES:
                self.pairs.clear()
            found = self.pairs[left, right] = self._apart(left, right)
        return found

    def _apart(self, left: bytes, right: bytes) -> bool:
        a, b = self.grown(left), self.grown(right)
        if not a or not b:
            return False
        xs, ys, i, j, ranks = a[1], b[0], 0, 0, self.ranks
        while True:
            (x, to_x), (y, to_y) = xs[i], ys[j]
            across = ranks.get(x + y, _NEVER)
            if across < to_x and across <= to_y:
                return False
            if to_x == to_y == _NEVER:
                return True
            if to_x <= to_y:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[bytes]) -> list[bytes]:
        """Adds to ``last`` (for a prefix of ``data``) the entries of the rest; last[i] ends data[:i + 1]."""
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.reach.get(data[max(0, end - 3) : end], 2)), end):
                token = data[start:end]
                if token in self.ranks and (self.adjacent(last[start - 1], token) if start else self.grown(token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}: single bytes are missing from the ranks")
        return last

    def tokens(self, last: list[bytes]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(self.ranks[last[end - 1]])
            end -= len(last[end - 1])
        return out[::-1]

    def entry(self, data: bytes) -> tuple[bytes, int, str, bytes]:
        """Of a prefix: its last token, the number of its ids, the ids as text, and the bytes they decode to.

        Asked for from the end backwards, so only those shorter prefixes get an entry whose last token may be
        followed by one that ends here; entries are kept for other words.
        """
        table, ranks = self.prefixes, self.ranks
        if (found := table.get(data)) is not None:
            return found
        end = len(data)
        for start in range(max(0, end - self.reach.get(data[-3:], 2)), end):
            token = data[start:]
            if (rank := ranks.get(token)) is None:
                continue
            if not start:
                if not self.grown(token):
                    continue
                found = token, 1, str(rank), self.token[rank]
            else:
                head = data[:start]
                before = table.get(head) or self.entry(head)
                if not self.adjacent(before[0], token):
                    continue
                found = token, before[1] + 1, f"{before[2]},{rank}", before[3] + self.token[rank]
            table[data] = found
            return found
        raise ValueError(f"no token ends at byte {end}: single bytes are missing from the ranks")

    def spelled(self, data: bytes) -> tuple[int, str, bytes]:
        """Of ``data``: the number of ids, the ids as text, comma-joined, and the bytes they decode to."""
        if (known := self.ranks.get(data)) is not None:
            return 1, str(known), self.token[known]
        if not data:
            return 0, "", b""
        if len(data) > 64:
            ids = self.tokens(self.extend(data, []))
            return len(ids), ",".join(map(str, ids)), b"".join(map(self.token.__getitem__, ids))
        if len(self.prefixes) >= PIECES:
            self.prefixes.clear()
        return self.entry(data)[1:]

    def encode(self, data: bytes) -> list[int]:
        return [int(x) for x in self.spelled(data)[1].split(",") if x]

    def edit(self, data: bytes, last: list[bytes], at: int, removed: int, added: bytes) -> tuple[bytes, list[bytes]]:
        """The bytes and prefix table after an edit; entries before ``at`` are kept, and the tail is kept from where it agrees again."""
        new = data[:at] + added + data[at + removed :]
        out, shift = last[:at], len(added) - removed
        agree = 0
        while len(out) < len(new):
            self.extend(new[: len(out) + 1], out)
            old = len(out) - shift
            agree = agree + 1 if len(out) > at + len(added) and out[-1] == last[old - 1] else 0
            if agree >= self.longest:  # all later entries depend on these only
                return new, out + last[old:]
        return new, out


class Codec(dict):
    """Encodes and decodes whole texts. As a dict it keeps what a chunk of text after a space encodes to."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder, self.pattern = PrefixEncoder(ranks), regex.compile(pattern)
        self.old: dict[str, tuple[int, str, bytes]] = {}

    def __missing__(self, chunk: str) -> tuple[int, str, bytes]:
        """Of a space and ``chunk``: the number of ids, the ids as text, and the bytes they decode to."""
        found = self.old.get(chunk) or self.spelled(f" {chunk}")
        if len(self) >= PIECES:
            self.old = dict(self)
            self.clear()
        if len(chunk) < 64:
            self[chunk] = found
        return found

    def spelled(self, text: str) -> tuple[int, str, bytes]:
        spell = self.encoder.spelled
        if text[1:].isalpha() and text[0] == " ":
            return spell(text.encode())
        parts = [spell(m.encode()) for m in self.pattern.findall(text)]
        if len(parts) == 1:
            return parts[0]
        return sum([x[0] for x in parts]), ",".join([x[1] for x in parts]), b"".join([x[2] for x in parts])

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.encoder.encode(m.encode())]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.encoder.token.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """(ids, SHA-256 of the ids, SHA-256 of the bytes they decode to).

        A space between two characters that aren't white space always begins a match, so the text
        is cut there, and the ids of each cut are kept.
        """
        first, *rest = _CUT.split(text) if _SPACES.search(text) else text.split(" ")
        found = list(map(self.__getitem__, rest))
        if first:
            found.append(self.spelled(first))
            found = found[-1:] + found[:-1]
        n, ids, data = zip(*found) if found else ((), (), ())
        return sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    claim("bpe", _codecs.clear)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; a null text is empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.encode(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) of every row of ids; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every whole text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no tokens, digests of no bytes. Rows are independent, repeated ones
    come out repeated; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            rows = [c.digest(t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
