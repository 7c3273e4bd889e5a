"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import ipaddress
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table

#: Kinds in the order of ties: the base ones, then those the checksums add.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "ipv6", "secret")
BASE = KINDS[:4]
#: Characters before and after a span in which context words count.
WINDOW = 48

# The first part of an address is found from its @ backwards, so no start is tried twice.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
# Possessive and only from the start of a run: a run that fails from its start fails from within.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country.
_IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
#: A value after : or =, and the names before them that make it a secret.
_VALUE = re.compile(r"""["' \t]{0,3}[:=][ \t]{0,3}["']?([A-Za-z0-9+/_.~-]{8,}={0,2})""")
_NAME = re.compile(r"(?:key|token|secret|passw(?:or)?d|pwd|passphrase|credentials?|bearer)$", re.I)
#: Forms that tell a secret by themselves: cloud and service keys, signed web tokens; and where a private key begins.
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)")
_PRIVATE = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
#: Bits a character of an assigned value must hold, in the mean: words and repeated characters hold less.
ENTROPY = 2.5

_CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write to|@", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login", re.I),
    "card": re.compile(r"card|credit|visa|payment|carte|tarjeta|karte", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|llam", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"ssn|social|security|insurance", re.I),
    "ipv6": re.compile(r"\bip\b|ipv6|address|host|server|login", re.I),
    "secret": re.compile(r"key|token|secret|passw|pwd|credential|bearer|auth", re.I),
}
_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "ipv6": 0.6, "secret": 0.6}
#: Added where a context word is near; an added kind must reach its least score to be reported.
CONTEXT_BONUS, LEAST = 0.3, {"iban": 0.8, "ssn": 0.6}


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces has the remainder 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = _LOCAL_BACK.match(text[done:at][::-1])
        domain = _DOMAIN.match(text, at + 1) if before else None
        if domain:
            yield at - before.end(), domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping IBANs. Capitals and digits may follow one after a space, so a match is tried at the
    length its country prescribes and then whole; that of an unknown country at each word border, the longest first."""
    m = _IBAN.search(text)
    while m:
        places = [i for i in range(m.start(), m.end()) if text[i] != " "]
        ends = [n for n in range(len(places), 14, -1) if n == len(places) or places[n] > places[n - 1] + 1]
        known = _IBAN_LENGTH.get(m[0][:2])
        if known:
            ends = [n for n in ends if n == known] + ends[: ends[0] != known]
        end = next((n for n in ends if mod97("".join(text[i] for i in places[:n]))), None)
        if end:
            yield m.start(), places[end - 1] + 1
        m = _IBAN.search(text, places[end - 1] + 1 if end else m.start() + 1)


def entropy(value: str) -> float:
    """Bits a character of ``value`` holds."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Keys of a known form, private keys up to their end line, and values assigned to a name that says so, by start."""
    found = [m.span() for m in _KEY.finditer(text)]
    for m in _PRIVATE.finditer(text):
        end = text.find("-----END", m.end())
        close = text.find("-----", end + 8) if end >= 0 else -1
        found.append((m.start(), close + 5 if close >= 0 else m.end()))
    for m in _VALUE.finditer(text):
        if _NAME.search(text[max(0, m.start() - 12) : m.start()]) and entropy(m[1]) >= ENTROPY:
            found.append(m.span(1))
    done = 0
    for start, end in sorted(found):
        if start >= done:
            yield start, end
            done = end


def ipv6s(text: str) -> Iterator[tuple[int, int]]:
    for m in _IPV6.finditer(text):
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        if len(m[0]) > 5:
            yield m.span()


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of every span of a whole text, by start, then kind as in ``KINDS``."""
    found = [(a, b, "email") for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x) < 4 and int(x or 0) < 256 for x in (part.lstrip("0") for part in m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdecimal, m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    found += [(a, b, "iban") for a, b in ibans(text)]
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            found.append((m.start(), m.end(), "ssn"))
    if ":" in text:
        found += [(a, b, "ipv6") for a, b in ipv6s(text)]
    found += [(a, b, "secret") for a, b in secrets(text)]
    scored = []
    for start, end, kind in found:
        near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
        score = min(1.0, _SCORE[kind] + CONTEXT_BONUS * bool(_CONTEXT[kind].search(near)))
        if score >= LEAST.get(kind, 0):
            scored.append((start, end, kind, score))
    return sorted(scored, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """The text with each stretch that spans cover replaced by the kind of its first span in brackets."""
    out, done, until = [], 0, 0
    for start, end, kind, _ in spans:
        if start >= until:
            out += [text[done:start], f"[{kind.upper()}]"]
            done = end
        done = until = max(until, done, end)
    return "".join([*out, text[done:]])


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind, score>>) of every whole text; a null text has none.

    Offsets count code points, ends are exclusive. Rows are independent: repeated ones come out
    repeated, an empty table gives no rows, extra columns are ignored.
    """
    kind = "array<struct<start:int,end:int,kind:string,score:double>>"
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("start", "end", "kind", "score"), x)) for x in find(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, shape)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {kind}")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced by the kind in brackets; n_chars, where there is one, follows.

    All rows and columns stay; a null text stays null.
    """
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t, find(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_spans(table(spark, sf_dir, "documents"))
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score")
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return spans.select("doc_id", *counts[:4], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *counts[4:], n_spans, score)
