"""Document fingerprints by consistent weighted sampling.

The terms of a text are its runs of five words, weighted by their counts.  For each of
``PLACES`` places every term and weight draws, from the hash of term and place alone,
gamma variables r and c and a uniform shift b.  With t = floor(ln w / r + b) the sample
is a = ln c - r (t - b) - r, and the smallest a over all terms wins, leaving (term, t).
Two texts leave the same sample with a probability equal to their generalised Jaccard
similarity; their likeness is the share of places with equal samples.

The variables come from three exponentials: c = e1 + e2, s = ln(c / e1), r = s + e3 and
b = 1 - s / r.  Then r and c are independent gamma(2) variables, b is uniform and
independent of both, and for weight 1 the sample is ln e1 with t = 0.  So among terms of
weight 1, the bulk of any text, the smallest hash wins and no logarithm is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_RANGES, bounded_sample, map_batches, map_rows, range_bounds, text_rows

PLACES = 128
SHINGLE = 5
#: Terms drawn at once, for all places.
BLOCK = 64
#: Word hashes a worker remembers before it starts afresh.
MEMO = 500_000
#: Documents in a range of neighbours.
RANGE_ROWS = 2048

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_words = _Words()


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x + np.uint64(int(_MIX[0]) * salt % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _uniforms(x: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform variables in (0, 1) from the halves of a mixed hash."""
    x = _mixed(x, salt)
    return ((x >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32, ((x & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's distinct runs of five words (of all words if fewer), and their counts.

    Words are separated by ASCII white space; A-Z are lower-cased.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    runs = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        runs = (runs * _MIX[1]) ^ (hashes[i : len(hashes) - size + 1 + i] * _MIX[0])
        runs ^= runs >> np.uint64(29)
    found, counts = np.unique(runs, return_counts=True)
    return found, counts.astype(np.float64)


def samples(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample a of each term at a place, and t, by consistent weighted sampling.

    A hash is one of term and place; for weight 1 the order of a is that of the hashes.
    """
    e1 = -np.log1p(-(hashes.astype(np.float64) + 0.5) * 2.0**-64)
    u2, u3 = _uniforms(hashes, 1)
    c = e1 - np.log(u2)
    s = np.log(c / e1)
    r = s - np.log(u3)
    shift = np.minimum(1 - s / r, 1 - 2.0**-53)
    t = np.floor(np.log(weights) / r + shift)
    return np.log(c) - r * (t - shift) - r, t


def _at_places(hashes: np.ndarray, salts: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Hashes of each term at each place, a row for each term; for one place no two terms' are equal."""
    out, spare = out[: len(hashes)], spare[: len(hashes)]
    np.bitwise_xor(hashes[:, None], salts[None], out=out)
    np.multiply(out, _MIX[1], out=out)
    np.right_shift(out, np.uint64(32), out=spare)
    np.bitwise_xor(out, spare, out=out)
    return np.multiply(out, _MIX[2], out=out)


def signature(text: str, places: int = PLACES) -> np.ndarray:
    """A 32-bit sample for each place, zero if the text has no word.  Equal texts have equal signatures.

    Different samples are taken for equal with a probability of 2^-32 at a place.
    """
    hashes, weights = terms(text)
    if not len(hashes):
        return np.zeros(places, np.uint32)
    salts = _mixed(np.arange(places, dtype=np.uint64), 4)
    out, spare = np.empty((2, min(BLOCK, len(hashes)), places), np.uint64)
    won = np.full(places, np.uint64(2**64 - 1))  # smallest hash among the terms of weight 1
    light = hashes[weights == 1]
    for i in range(0, len(light), BLOCK):
        np.minimum(won, _at_places(light[i : i + BLOCK], salts, out, spare).min(axis=0), out=won)
    best, steps = samples(won, np.ones(places))[0] if len(light) else np.full(places, np.inf), np.zeros(places)
    heavy = np.flatnonzero(weights != 1)
    for i in range(0, len(heavy), BLOCK):
        some = heavy[i : i + BLOCK]
        found = _at_places(hashes[some], salts, out, spare)
        a, t = samples(found, weights[some, None])
        row, column = a.argmin(axis=0), np.arange(places)
        a, t, found = a[row, column], t[row, column], found[row, column]
        better = a < best
        best, steps, won = np.where(better, a, best), np.where(better, t, steps), np.where(better, found, won)
    return (_mixed(won ^ _mixed(steps.astype(np.int64).view(np.uint64), 5), 6) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of places with equal samples; 1 if neither text has a word."""
    return float((x == y).mean())


def written(x: np.ndarray) -> str:
    """Signature as text, eight hex digits for each place: all that ``likeness`` compares."""
    return x.astype(">u4").tobytes().hex()


RANGED = "doc_id long, text string, k long, h long, range int, guest boolean"


class Cuts:
    """Increasing bounds (k, h); a row's range is the number of bounds that are not above it."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.k, self.h = (np.array([x[i] for x in pairs], np.int64) for i in (0, 1))

    def ranges(self, k: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.k, k, side="left"), np.searchsorted(self.k, k, side="right")
        for at in np.unique(low[low < high]):  # ids that are bounds themselves: their rows go by h
            rows = np.flatnonzero((low == at) & (low < high))
            end = high[rows[0]]
            low[rows] = at + np.searchsorted(self.h[at:end], h[rows], side="right")
        return low


def neighbour_ranges(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, text) with columns range and guest, to be read in descending order, and the number of ranges.

    Ranges cut the order doc_id descending, null last, then by the text's hash, so that
    neither a range of ids nor the rows of one repeated id are bound to one task.  The rows
    of a range's largest (id, hash) are also sent, as guests, to the end of the range before it;
    those of the first range go to the end of the last.  So each row finds its next one in
    its own range, and a range is read as a stream.  Bounds come from a bounded sample;
    they move work between tasks and change no result.
    """
    keyed = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64("text", F.col("text").isNull()).alias("h"))
    total = rows.count()
    ranges = max(1, min(MOST_RANGES, -(-total // RANGE_ROWS)))
    sample = bounded_sample(keyed, F.struct("k", "h"), 8 * ranges, total) if ranges > 1 else []
    cuts = Cuts(range_bounds([(r.k, r.h) for r in sample], ranges))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, int]] = {}
        for batch in batches:
            k, h = (batch.column(c).to_numpy() for c in ("k", "h"))
            places = cuts.ranges(k, h)
            order = np.lexsort((h, k, places))
            last = order[np.flatnonzero(np.diff(places[order], append=-1))]
            for place, pair in zip(places[last].tolist(), zip(k[last].tolist(), h[last].tolist(), strict=True), strict=True):
                found[place] = max(found.get(place, pair), pair)
        yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int32()), *(pa.array([x[i] for x in found.values()], pa.int64()) for i in (0, 1))], ["range", "k", "h"])

    tops = keyed.select("k", "h").mapInArrow(ends, "range int, k long, h long").groupBy("range").agg(F.max(F.struct("k", "h")).alias("top"))
    known = sorted(((r["range"], r["top"]["k"], r["top"]["h"]) for r in tops.collect()), reverse=True)  # a row for each range
    top = np.full((2, len(cuts.k) + 1), -(2**63), np.int64)
    before = np.zeros(len(cuts.k) + 1, np.int64)
    for i, (place, k, h) in enumerate(known):
        top[:, place], before[place] = (k, h), known[i - 1][0]

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        k, h = (batch.column(c).to_numpy() for c in ("k", "h"))
        places = cuts.ranges(k, h)
        guests = np.flatnonzero((k == top[0, places]) & (h == top[1, places]))
        whole = pa.Table.from_batches([batch])
        table = pa.concat_tables([whole, whole.take(pa.array(guests))])
        table = table.append_column("range", pa.array(np.concatenate([places, before[places[guests]]]), pa.int32()))
        return table.append_column("guest", pa.array(np.arange(len(table)) >= len(k))).combine_chunks().to_batches()[0]

    return map_batches(keyed, dealt, RANGED), len(cuts.k) + 1


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text and its edited text, a row for each row of ``docs``.

    The edited text replaces the last third of the code points by as many first ones
    (or all) of the next document in descending doc_id; the last is followed by the
    first, and a lone document by itself.  A null text is empty, and texts without a word are
    all alike.  Rows of equal doc_id follow each other by their text's hash, so ties and
    repeated rows have one order; a null doc_id comes last.  A very long text is read whole, its
    terms in blocks.  Other columns are ignored and an empty table gives no rows.
    """
    ranged, ranges = neighbour_ranges(text_rows(docs))
    order = [F.col("range"), F.col("guest"), F.col("k").desc(), F.col("h").desc()]
    dealt = ranged.repartitionById(ranges, F.col("range")).sortWithinPartitions(*order).select("doc_id", "text", "range", "guest")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        waiting = None  # doc_id, text, signature of the row whose next has not come yet
        in_range, over = None, False
        for doc_id, text, own, guest in rows:
            if own != in_range:
                in_range, over, waiting = own, False, None
            if over:  # further copies of the guest
                continue
            text = text or ""
            sign = waiting[2] if waiting and waiting[1] == text else signature(text)
            if waiting:
                yield compared(*waiting, text, sign)
            waiting, over = (None, True) if guest else ((doc_id, text, sign), False)

    return map_rows(dealt, run, SCHEMA)


def compared(doc_id: int | None, text: str, sign: np.ndarray, after: str, after_sign: np.ndarray) -> tuple:
    """One row of the result."""
    last = len(text) // 3
    edited = text[: len(text) - last] + after[:last]
    edited_sign = sign if edited == text else signature(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(sign), written(edited_sign), likeness(sign, edited_sign), likeness(sign, after_sign)
