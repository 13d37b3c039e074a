"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has a bit set if over half of its shingle hashes have it.
Two 64-bit fingerprints that differ in k <= 3 bits, cut into two halves of 32 bits,
have a half that differs in at most one bit.  Each fingerprint is indexed under the
32 variants of either half with one bit wiped out; equal keys are joined and each
candidate is verified.

No step lists all pairs of a group.  Equal fingerprints are one from the start.  A
bucket is reduced to a spanning star for each of its linked parts.  A bucket over
``BUCKET`` fingerprints is first indexed again under variants of the other half, after
which at most 18 bits are free.  Buckets of a half that over ``CROWDED`` fingerprints
share are dealt by such variants before they are gathered, so a task never holds more
than the larger of 2 * ``CROWDED`` and 2^18 fingerprints of a bucket, at any size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, strings, text_rows

SEED = 42
NEAR = 3
#: Fingerprints of a bucket that are compared directly.
BUCKET = 2048
#: Fingerprints that share a half before its buckets are dealt by the other half as well.
CROWDED = 2048
#: Rows of a table of keys that are broadcast at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def shingle_hashes(text: str, size: int = 3) -> np.ndarray:
    """XXH64 of each run of ``size`` words; of all words if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = zip(*(words[i:] for i in range(size)), strict=False)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, len(words) - size + 1)


def fingerprint(text: str) -> int:
    """64-bit SimHash, zero for a text without words."""
    hashes = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        some = hashes[at : at + 65536].astype(">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id, ``fp`` (the fingerprint as a signed long) and the ``kept`` long expressions over text of each row."""
    names = [f"k{i}" for i in range(len(kept))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in strings(batch, "text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), *map(batch.column, names)], ["doc_id", "fp", *names])

    rows = text_rows(docs).selectExpr("*", *(f"{x} AS {n}" for x, n in zip(kept, names, strict=True)))
    return map_batches(rows, run, ", ".join(f"{n} long" for n in ("doc_id", "fp", *names)))


def linked_parts(fps: np.ndarray) -> np.ndarray:
    """For each of the sorted, distinct fingerprints the smallest one that a chain of links within ``fps`` reaches.

    A fingerprint at a time takes in all that are near; up to ``BUCKET`` of them are compared in blocks.
    """
    label = np.arange(len(fps))
    waiting = np.ones(len(fps), bool)
    for i in range(len(fps)):
        if not waiting[i]:
            continue
        waiting[i] = False
        reach = np.array([i])
        while len(reach) and waiting.any():
            rest = np.flatnonzero(waiting)
            near = np.zeros(len(rest), bool)
            for at in range(0, len(reach), 256):
                near |= (np.bitwise_count(fps[reach[at : at + 256], None] ^ fps[rest]) <= NEAR).any(axis=0)
            reach = rest[near]
            label[reach] = i
            waiting[reach] = False
    return fps[label]


def linked_cube(fps: np.ndarray) -> np.ndarray:
    """The same for many fingerprints that vary in few bits: each looks its neighbours up.

    The cost is linear in their number; the varying bits (18 at most) bound the neighbours.
    """
    label = np.arange(len(fps))
    varies = int(np.bitwise_or.reduce(fps) ^ np.bitwise_and.reduce(fps))
    bits = [np.uint64(1 << b) for b in range(64) if varies >> b & 1]
    masks = [np.bitwise_or.reduce(np.array(c, np.uint64)) for n in range(1, NEAR + 1) for c in combinations(bits, n)]
    while True:
        before = label.copy()
        for mask in masks:
            at = np.minimum(np.searchsorted(fps, fps ^ mask), len(fps) - 1)
            hit = fps[at] == fps ^ mask
            label[hit] = np.minimum(label[hit], label[at[hit]])
        label = label[label]
        if (label == before).all():
            return fps[label]


def bucket_links(fps: np.ndarray, high_half: bool | None, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Append the links of one bucket: each member with the smallest of its linked part.

    ``high_half`` tells which half the bucket is indexed by; null for one that is already
    indexed by both.  A crowded bucket is indexed by the other half's quarters, one of
    which differs by a bit at most, one variant at a time.
    """
    if len(fps) <= BUCKET or high_half is None:
        found = linked_parts(fps) if len(fps) <= BUCKET else linked_cube(fps)
        out.append((fps[fps != found], found[fps != found]))
        return
    for quarter in (0, 16) if high_half else (32, 48):
        part = fps >> np.uint64(quarter) & np.uint64(0xFFFF)
        for j in range(16):
            key = part & np.uint64(~(1 << j) & 0xFFFF)
            order = np.argsort(key, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(group) > 1:
                    bucket_links(fps[group], None, out)


def stars(rows: DataFrame) -> DataFrame:
    """Links (a, b) within the buckets of ``rows`` (key, other, fp), read as a stream in their order.

    Links of a bucket join each member with the smallest of its linked part.  The members
    of a bucket of two are compared directly, all such buckets of a batch at once; other
    buckets whose members were met just before in the same task are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()

        def links(key: np.ndarray, other: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            start = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (other[1:] != other[:-1])) + 1, [len(fp)]])
            size = np.diff(start)
            two = start[:-1][size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= NEAR]
            out = [(np.maximum(fp[two], fp[two + 1]), np.minimum(fp[two], fp[two + 1]))]
            for i in np.flatnonzero(size > 2):
                members = np.sort(fp[start[i] : start[i + 1]])
                name = members.tobytes() if len(members) <= 64 else b""
                if name in met:
                    continue
                if name:
                    if len(met) >= 100_000:
                        met.clear()
                    met.add(name)
                bucket_links(members, None if other[start[i]] >= 0 else bool(key[start[i]] >> 32 >= 32), out)
            pairs = np.unique(np.stack([np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])], axis=1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        open_bucket: list[tuple[np.ndarray, ...]] = []  # what has come of the last bucket, joined once it is whole
        for batch in batches:
            if not batch.num_rows:
                continue
            key, other, fp = (batch.column(c).to_numpy() for c in ("key", "other", "fp"))
            now = (key, other, fp.view(np.uint64))
            if open_bucket and (open_bucket[0][0][0], open_bucket[0][1][0]) == (key[-1], other[-1]):
                open_bucket.append(now)
                continue
            before = np.flatnonzero((key != key[-1]) | (other != other[-1]))
            begin = before[-1] + 1 if len(before) else 0  # of the last bucket in this batch
            open_bucket.append(tuple(x[:begin] for x in now))
            if any(len(x[0]) for x in open_bucket):
                yield links(*(np.concatenate(x) for x in zip(*open_bucket, strict=True)))
            open_bucket = [tuple(x[begin:] for x in now)]
        if open_bucket:
            yield links(*(np.concatenate(x) for x in zip(*open_bucket, strict=True)))

    return rows.repartition("key", "other").sortWithinPartitions("key", "other").mapInArrow(run, "a long, b long")


def _variants(fp: str, low: int, width: int) -> str:
    """SQL: an array of keys, one for each bit of the ``width`` bits from ``low`` wiped out.

    A key holds the wiped position above the remaining bits.
    """
    part = f"(shiftrightunsigned({fp}, {low}) & {(1 << width) - 1}L)"
    return f"transform(sequence(0, {width - 1}), j -> ({part} & ~shiftleft(1L, j)) | shiftleft(cast({low} + j AS BIGINT), {width}))"


def few(df: DataFrame) -> bool:
    """Whether ``df`` may be broadcast; reads no more rows than that."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) whose connected parts are those of all pairs within ``NEAR`` bits.

    ``distinct``: a column ``fp`` without repeats.  All variants go through one shuffle.
    Halves that more than ``CROWDED`` fingerprints share are found first, and their buckets
    are dealt by the other half as well.  Their keys are broadcast only if they are few.
    """
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A row becomes 64, so rows are dealt anew: left where they are, few tasks would hold them all.
    spread = distinct.select("fp").repartition(parts, F.expr("shiftrightunsigned(fp, 1)"))
    halves = spread.selectExpr(f"explode(array(fp & {2**32 - 1}L, shiftrightunsigned(fp, 32) | {2**32}L)) AS half")
    hot = cut(halves.groupBy("half").count().where(F.col("count") > CROWDED).select("half"))
    keyed = spread.selectExpr("fp", f"explode(concat({_variants('fp', 0, 32)}, {_variants('fp', 32, 32)})) AS key")
    if hot.isEmpty():
        return stars(keyed.select("key", F.lit(-1).cast("long").alias("other"), "fp")).distinct()
    wiped = f"explode(transform(sequence(0, 31), j -> (half & {2**32 - 1}L & ~shiftleft(1L, j)) | shiftleft(shiftrightunsigned(half, 32) * 32L + j, 32))) AS key"
    crowded = cut(hot.selectExpr(wiped).distinct().withColumn("hot", F.lit(True)))
    marked = keyed.join(F.broadcast(crowded) if few(crowded) else crowded, "key", "left")
    low, high = (f"concat({_variants('fp', at, 16)}, {_variants('fp', at + 16, 16)})" for at in (0, 32))
    other = f"explode(CASE WHEN hot IS NULL THEN array(-1L) WHEN shiftrightunsigned(key, 32) < 32 THEN {high} ELSE {low} END) AS other"
    return stars(marked.selectExpr("key", other, "fp")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected part, for nodes that have a link.

    Large-star and small-star steps alternate until nothing changes.  A step takes the
    minimum of each node's neighbours, partially summed before the shuffle, and joins it
    back; no neighbour list is ever gathered.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())

    def size(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)"), F.expr("coalesce(bit_xor(xxhash64(b, a, 7)), 0)")).first())

    now = size(edges)
    while now[0]:
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        down = large.selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").selectExpr("b AS a", "m AS b").unionByName(least.selectExpr("a", "m AS b")).where("a <> b").distinct()
        edges = cut(small)
        then, now = now, size(edges)
        if then == now:
            break
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def parts(fps: DataFrame) -> DataFrame:
    """(fp, root) for distinct fingerprints: the name of the connected part of each."""
    roots = connected(links(fps.select("fp")))
    return fps.join(roots, fps.fp == roots.node, "left").select(*fps.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Connected parts of documents whose fingerprints differ in at most ``NEAR`` bits.

    Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id
    reachable, a row for each row of ``docs``.  Null and blank texts have fingerprint
    zero and link like any other.  A null doc_id belongs to its part but never names it
    unless the part has no other.  Repeated rows come back repeated, rows of one doc_id
    with different texts are judged each by its text, extra columns are ignored, a very
    long text is read whole and an empty table gives no rows.
    """
    found = cut(fingerprints(docs))
    of = parts(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(names, "root").select("fp", "component_id")
    return found.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each connected part one row stays, all columns as they are.

    It is the row of smallest doc_id, nulls last, then of smallest text hash.  So two
    unrelated texts of one doc_id both stay, near copies without a doc_id are one, and of
    repeated rows one is left.  What is decided carries ids and two 64-bit hashes of the
    texts; the texts themselves go through one shuffle, when the rows to keep are met.
    """
    columns = docs.columns
    taken = {c.lower() for c in columns}
    marks = []
    for name in ("id", "h1", "h2"):
        while name in taken:
            name += "_"
        marks.append(name)
    hashes = ("xxhash64(text, text IS NULL)", "xxhash64(1, text)")
    found = cut(fingerprints(docs, *hashes)).withColumnsRenamed({"k0": "h1", "k1": "h2"})
    rows = found.groupBy("fp", "doc_id", "h1", "h2").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "n")
    least = rows.groupBy("fp").agg(F.min(first).alias("row"))
    chosen = parts(cut(least)).groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    keep = cut(chosen.select(*(F.col(c).alias(m) for c, m in zip(("doc_id", "h1", "h2"), marks, strict=True)), "n"))
    own = docs.select("*", F.col("doc_id").cast("long").alias(marks[0]), *(F.expr(x.replace("text", "CAST(text AS STRING)")).alias(m) for x, m in zip(hashes, marks[1:], strict=True)))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        same = [left[marks[0]].eqNullSafe(right[marks[0]]), *(left[m] == right[m] for m in marks[1:])]
        return left.join(right, same, "left_semi")

    # The side that is built from holds 40 bytes a document, a few hundredths of its texts; sorting texts is saved.
    once = met(own, keep.where("n = 1").hint("shuffle_hash")).select(*columns)
    again = keep.where("n > 1")
    if again.isEmpty():
        return once
    repeated = met(own, F.broadcast(again) if few(again) else again)
    return once.unionByName(repeated.dropDuplicates(marks).select(*columns))
