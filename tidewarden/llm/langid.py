"""Language identification by a byte convolutional network trained in numpy.

Bytes fall into classes (letters folded to lower case, digits, white space, other
ASCII, each byte from 128 up) with learned embeddings.  Filters of widths 2, 3 and 4
run over fixed-length windows, the largest response of each filter in a window is
kept, and a softmax layer scores the languages.  A document's probabilities are the
means over all its windows, so whole texts count.

For prediction the trained filters are laid out as tables over pairs of byte classes:
a filter of width 4 is the sum of two look-ups.  It is the same network.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, strings, text_rows

WINDOW = 128
WIDTHS = (2, 3, 4)
#: Bounds of the training sample: documents of each language, windows of a document, documents in all.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_ALL = 300, 4, 60_000
#: Windows that are scored at once.
TOGETHER = 2048
PAD, SPACE, DIGIT, OTHER = 0, 1, 2, 3
CLASSES = 4 + 26 + 128
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    table[48:58] = DIGIT
    table[65:91] = table[97:123] = np.arange(4, 30)
    table[128:] = np.arange(30, CLASSES)
    return table


_CLASS = _classes()
_REACH = max(WIDTHS) - 1


def byte_classes(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]


def windows(codes: np.ndarray) -> np.ndarray:
    """All windows of ``WINDOW`` filter places, each with the bytes the filters reach beyond it, padded at the end."""
    n = max(1, -(-len(codes) // WINDOW))
    padded = np.zeros(n * WINDOW + _REACH, np.uint8)
    padded[: len(codes)] = codes
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + _REACH)[::WINDOW]


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # classes x e
    filters: list[np.ndarray]  # of each width: (width * e) x f
    biases: list[np.ndarray]
    output: np.ndarray
    output_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width, look-up tables over pairs of classes for its first two places and its other places."""
        e = self.embedding.shape[1]
        out = []
        for width, weights, bias in zip(WIDTHS, self.filters, self.biases, strict=True):
            one = [self.embedding @ weights[i * e : (i + 1) * e] for i in range(width)]
            first = (one[0][:, None] + one[1][None, :] + bias).reshape(CLASSES**2, -1)
            rest = None
            if width > 2:
                after = one[3][None, :] if width > 3 else np.zeros_like(one[2])[None, :]
                rest = (one[2][:, None] + after).reshape(CLASSES**2, -1)
            out.append((np.ascontiguousarray(first, np.float32), None if rest is None else np.ascontiguousarray(rest, np.float32)))
        return out

    def score(self, rows: np.ndarray, tables: list | None = None) -> np.ndarray:
        """Softmax probabilities of each window."""
        tables = tables or self.tables()
        at = rows.T.astype(np.int32)  # places x windows, so the maximum runs over whole rows
        pairs = at[:-1] * CLASSES + at[1:]
        pooled = []
        for first, rest in tables:
            best = None
            for i in range(WINDOW):  # every place is read; a row holds all windows of the batch
                here = first[pairs[i]]
                if rest is not None:
                    here += rest[pairs[i + 2]]
                best = here if best is None else np.maximum(best, here, out=best)
            pooled.append(np.maximum(best, 0))
        z = np.concatenate(pooled, axis=1) @ self.output + self.output_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7, width: int = 8, filters: int = 16, epochs: int = 6, rate: float = 0.01) -> Network:
    """Fit the network by Adam on windows; the result depends on the arguments alone."""
    random = np.random.default_rng(seed)
    shape = (CLASSES, width)
    names = ["e", *(f"w{i}" for i in WIDTHS), *(f"b{i}" for i in WIDTHS), "o", "c"]
    values = [random.normal(0, 0.3, shape), *(random.normal(0, (1 / (i * width)) ** 0.5, (i * width, filters)) for i in WIDTHS), *(np.zeros(filters) for _ in WIDTHS), random.normal(0, 0.2, (filters * len(WIDTHS), len(languages))), np.zeros(len(languages))]
    p = {k: v.astype(np.float32) for k, v in zip(names, values, strict=True)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(len(rows)), max(1, len(rows) // 32)):
            x, y = rows[batch].astype(np.int64), labels[batch]
            n = len(batch)
            embedded = p["e"][x]
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            pooled, places, inputs = [], [], []
            for w in WIDTHS:
                view = np.concatenate([embedded[:, i : i + WINDOW] for i in range(w)], axis=2)
                response = view.reshape(n * WINDOW, -1) @ p[f"w{w}"] + p[f"b{w}"]
                response = response.reshape(n, WINDOW, filters)
                place = response.argmax(axis=1)
                pooled.append(np.take_along_axis(response, place[:, None], axis=1)[:, 0])
                places.append(place)
                inputs.append(view)
            joined = np.concatenate(pooled, axis=1)
            active = np.maximum(joined, 0)
            z = active @ p["o"] + p["c"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), y] -= 1
            z /= n
            grads["o"], grads["c"] = active.T @ z, z.sum(axis=0)
            back = (z @ p["o"].T) * (joined > 0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * filters : (i + 1) * filters]
                picked = inputs[i][np.arange(n)[:, None], places[i]]  # n x filters x (w * width)
                grads[f"w{w}"] = np.einsum("nfd,nf->df", picked, g)
                grads[f"b{w}"] = g.sum(axis=0)
                spread = (g[:, :, None] * p[f"w{w}"].T[None]).reshape(n, filters, w, width)
                for j in range(w):
                    np.add.at(grads["e"], x[np.arange(n)[:, None], places[i] + j], spread[:, :, j])
            step += 1
            for k, v in p.items():
                m, s = moment[k]
                m += 0.1 * (grads[k] - m)
                s += 0.001 * (grads[k] ** 2 - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p["e"], [p[f"w{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["o"], p["c"])


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(language, codes of a window) of the training sample, in an order that depends on the texts alone.

    Eligible are rows that are not held out, with a text and a language.  Of each language the
    ``SAMPLE_DOCS`` different texts of smallest hash are taken, fewer if there are so many
    languages that ``SAMPLE_ALL`` would be passed, and of each text ``SAMPLE_WINDOWS`` windows
    at even steps.  A text counts once however many rows have it, so neither copies nor null
    or repeated ids change how much arrives.  Every language of the table is learned; more
    than ``SAMPLE_ALL`` of them are an error.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64(F.lit(11), "text").alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(SAMPLE_ALL + 1).collect()
    if len(counts) > SAMPLE_ALL:
        raise ValueError(f"more than {SAMPLE_ALL} values of lang")
    if not counts:
        return []
    each = min(SAMPLE_DOCS, SAMPLE_ALL // len(counts))
    # The count is an estimate: half as many again are met, and those of smallest hash are kept below.
    shares = [(r["lang"], min(2**63 - 1, (2**63 - 1) * (3 * each + 40) // (2 * max(1, r["n"])))) for r in counts]
    bounds = docs.sparkSession.createDataFrame(shares, "lang string, bound long")  # SAMPLE_ALL rows at most

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, hashes, found = [], [], []
        for lang, text, h in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "h")), strict=True):
            all_windows = windows(byte_classes(text))
            langs.append(lang)
            hashes.append(h)
            found.append([all_windows[i].tobytes() for i in sorted({len(all_windows) * j // SAMPLE_WINDOWS for j in range(SAMPLE_WINDOWS)})])
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(found, pa.list_(pa.binary()))], ["lang", "h", "codes"])

    met = rows.join(F.broadcast(bounds), "lang").where(F.col("h").bitwiseAND(F.lit(2**63 - 1)) <= F.col("bound")).select("lang", "text", "h")
    picked = map_batches(met, pick, "lang string, h long, codes array<binary>").groupBy("lang", "h").agg(F.min("codes").alias("codes")).collect()
    out, taken = [], {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["h"] & (2**63 - 1), r["h"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= each:
            out += [(r["lang"], bytes(c)) for c in r["codes"]]
    return out


def fit(docs: DataFrame) -> Network | None:
    """Train on ``sample``; null if it is empty."""
    found = sample(docs)
    if not found:
        return None
    languages = sorted({lang for lang, _ in found})
    number = {lang: i for i, lang in enumerate(languages)}
    codes = np.frombuffer(b"".join(c for _, c in found), np.uint8).reshape(-1, WINDOW + _REACH).copy()
    labels = np.array([number[lang] for lang, _ in found])
    # Short texts are met too: of every fourth window only a beginning is left.
    lengths = 12 + np.arange(len(codes)) * 37 % 80
    for i in range(0, len(codes), 4):
        codes[i, lengths[i] :] = PAD
    return train(codes, labels, languages)


class Predictor:
    """A network ready for texts; the look-up tables are built in each task."""

    def __init__(self, network: Network | None):
        self.network = network
        self.tables = None

    def __getstate__(self) -> dict:
        return {"network": self.network, "tables": None}

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text: ``und`` and 0 if it has no letter or nothing was learned."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        if self.network is None:
            return out
        self.tables = self.tables or self.network.tables()
        sums: dict[int, np.ndarray] = {}
        lengths: dict[int, int] = {}
        waiting: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            scores = self.network.score(np.concatenate([w for _, w in waiting]), self.tables)
            starts = np.cumsum([0, *(len(w) for _, w in waiting[:-1])])
            for (i, _), total in zip(waiting, np.add.reduceat(scores.astype(np.float64), starts, axis=0), strict=True):
                sums[i] = sums.get(i, 0) + total

        for i, text in enumerate(texts):
            if not _LETTER.search(text):
                continue
            rows = windows(byte_classes(text))
            lengths[i] = len(rows)
            for start in range(0, len(rows), TOGETHER):  # of a long text some windows at a time
                part = rows[start : start + TOGETHER]
                waiting.append((i, part))
                size += len(part)
                if size >= TOGETHER:
                    flush()
                    waiting, size = [], 0
        if waiting:
            flush()
        for i, total in sums.items():
            best = int(total.argmax())
            out[i] = (self.network.languages[best], min(1.0, float(total[best]) / lengths[i]))
        return out


def identify(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """Predict the language of every whole text, a row for each row of ``docs``.

    Returns doc_id, held_out, lang_pred and score (0 to 1).  Without ``network`` one is
    fitted on the rows that are not held out.  A null text, or one without a letter, is
    ``und`` with score 0, as is everything if nothing could be learned.  A null doc_id
    is not held out.  Of languages of equal probability the first in order is taken.  A
    very long text is read whole, some windows at a time; repeated rows come back repeated,
    other columns are ignored, and an empty table gives no rows.
    """
    predictor = Predictor(network or fit(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = predictor.predict(strings(batch, "text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(text_rows(docs), run, "doc_id long, lang_pred string, score double").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, network: Network | None = None, least: float = 0.4) -> DataFrame:
    """The documents whose language is known with a score of ``least`` or more; columns and repeated rows stay as they are."""
    predictor = Predictor(network or fit(docs))
    schema = docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [lang != UNKNOWN and score >= least for lang, score in predictor.predict(strings(batch, "text"))]
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, schema)
