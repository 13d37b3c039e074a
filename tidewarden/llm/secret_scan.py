"""Secret scans: patterns, and sliding-window Shannon entropy per character class.

A candidate is a run of key characters.  Windows slide over it one character at a
time; counts are updated for the character that enters and the one that leaves, and
the entropy follows from a running sum.  Each character class (runs of hex digits, and the
candidate's key characters without them) has its own window and threshold.  The union of
the windows above the threshold is a span unless the allow-list suppresses it.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, strings, text_rows

# The base patterns, kinds in the order in which they sort.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_key")

_ASSIGN_WORD = re.compile(r"password|passwd|secret|token|api_?key", re.A | re.I)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_HEX_RUN = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])")


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    window: int
    bits: float


HEX_CLASS = CharacterClass("entropy_hex", 24, 3.2)
KEY_CLASS = CharacterClass("entropy_key", 24, 3.9)

# Wording and sequences that suppress a span, and shapes that are cut out of a candidate.
ALLOWED = (
    re.compile(r"example|sample|dummy|placeholder|changeme|your[_-]?(?:key|token|secret)", re.I),
    re.compile(r"abcdefgh|01234567|12345678|qwertyui", re.I),
)
CUT = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|^/*(?:https?|www)(?=/|$)|(?:^|(?<=/))/?[a-z]+/", re.I | re.A)
_WORDS = re.compile(r"[A-Za-z]{0,2}(?:[A-Z]{0,2}+[a-z]{3,}+|[A-Z]{3,}+|(?<![A-Za-z0-9])[A-Za-z]{1,2}+(?![A-Za-z0-9])|[0-9]++|[+/_=-]++)++[A-Za-z]{0,2}")
#: The shortest candidate, and how far around a span wording is looked for.
SHORTEST, AROUND = 20, 8


def entropy_spans(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Unions of the windows of ``text`` whose Shannon entropy is at least ``bits``."""
    n = len(text)
    if n < window:
        return []
    log = [0.0, *(i * math.log2(i) for i in range(1, window + 1))]
    counts: dict[str, int] = {}
    total = 0.0  # of count * log2(count); the entropy is log2(window) - total / window
    limit = window * (math.log2(window) - bits) + 1e-9
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        if i >= window:
            out = text[i - window]
            k = counts[out]
            total += log[k - 1] - log[k]
            counts[out] = k - 1
        k = counts.get(c, 0)
        total += log[k + 1] - log[k]
        counts[c] = k + 1
        if i >= window - 1 and total <= limit:
            start = i + 1 - window
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def allowed(span: str, around: str | None = None) -> bool:
    """Whether the allow-list suppresses a span: no letter, words with under 3 digits, or known wording in or around it."""
    if not any(c.isalpha() for c in span) or (sum(c.isdigit() for c in span) < 3 and _WORDS.fullmatch(span)):
        return True
    return any(p.search(around or span) for p in ALLOWED)


def pieces(candidate: str) -> list[tuple[int, int]]:
    """What is left of a candidate, as places, without the shapes that are no secrets."""
    out, last = [], 0
    for m in CUT.finditer(candidate):
        out.append((last, m.start()))
        last = m.end()
    return [(a, b) for a, b in (*out, (last, len(candidate))) if b - a >= SHORTEST]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Base matches as (start, end, kind), leftmost and non-overlapping within a kind."""
    found = []
    if _ASSIGN_WORD.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return _ordered(found)


def method_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of high entropy as (start, end, kind)."""
    found = []
    for m in _CANDIDATE.finditer(text):
        for begin, end in pieces(m.group()):
            for a, b, kind in classes(m.group(), begin, end):
                part, start = m.group()[a:b], m.start() + a
                window = min(kind.window, len(part))  # a shorter part is one window, its threshold scaled to its length
                for x, y in entropy_spans(part, window, kind.bits * math.log2(window) / math.log2(kind.window)):
                    if not allowed(part[x:y], part[max(0, x - AROUND) : y + AROUND]):
                        found.append((start + x, start + y, kind.kind))
    return found


def classes(candidate: str, begin: int, end: int) -> list[tuple[int, int, CharacterClass]]:
    """A piece of a candidate cut into whole runs of hex digits and what is between them, where it is long enough."""
    out, last = [], begin
    for m in _HEX_RUN.finditer(candidate, begin, end):
        out += [(last, m.start(), KEY_CLASS), (m.start(), m.end(), HEX_CLASS)]
        last = m.end()
    return [x for x in (*out, (last, end, KEY_CLASS)) if x[1] - x[0] >= SHORTEST]


def _ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Find secrets in every whole text, a row for each row of ``docs``.

    Spans are in code points, end exclusive.  A null or empty text has none; its digest
    is that of the empty string.  A very long text is read whole.  Spans of different kinds may overlap;
    of two that begin together the kind named first comes first.  Repeated rows and null
    ids come back as they are, other columns are ignored, and an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in strings(batch, "text"):
            base = base_spans(text)
            kinds = [k for _, _, k in base]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(listed(base).encode()).hexdigest(), listed(_ordered(base + method_spans(text)))))
        types = [pa.int64()] * 3 + [pa.string()] * 2
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [c.split()[0] for c in SCHEMA.split(", ")])

    return map_batches(text_rows(docs), run, SCHEMA)


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every secret replaced; of an assignment the name stays."""
    spans = []
    for a, b, kind in base_spans(text) + method_spans(text):
        if kind == "assign" and (m := ASSIGN.match(text, a)):
            a = m.start(2)
        spans.append((a, b))
    out, done = [], 0
    for a, b in sorted(spans):
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], mark]
        done = b
    return "".join(out) + text[done:]


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with secrets masked in their texts; rows and columns stay, n_chars follows the text.

    A null text stays null, and repeated rows stay repeated.
    """

    @F.arrow_udf("string")
    def mask(column: pa.Array) -> pa.Array:
        some = [column.slice(i, 256) for i in range(0, len(column), 256)]  # so that texts are not all held twice
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else redact(t) for t in part.to_pylist()], pa.string()) for part in some)])

    masked: Column = mask(F.col("text"))
    out = docs.withColumn("text", masked)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
