"""First-fit decreasing packing with a tournament tree of bin capacities.

Tokenising cuts each document, with its end id, at multiples of the sequence
length.  Only the pieces' sizes and checksums are dealt into randomised groups;
token ids are never shuffled.  A group has a bounded expected number of
documents, so packing it takes bounded memory, and groups are independent.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import share
from .common import map_batches, strings, text_rows

PIECES = "doc_id long, h long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Tournament tree: a node holds the largest free capacity of the bins below it."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin that has room; returns the bin and its free capacity before."""
        best, node = self.best, 1
        while node < self.width:
            node *= 2
            if best[node] < size:
                node += 1
        free = best[node]
        best[node] = free - size
        place = node - self.width
        while node > 1:
            node >>= 1
            best[node] = max(best[2 * node], best[2 * node + 1])
        return place, free


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size; ``sizes`` must not exceed ``capacity``.

    Larger sizes go first, equal ones in the order given.  A full size takes a bin alone.
    """
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    full = 0
    while full < len(order) and sizes[order[full]] == capacity:
        bins[order[full]] = full
        full += 1
    tree = CapacityTree(len(order) - full, capacity)
    for i in order[full:]:
        place, free = tree.place(sizes[i])
        bins[i], offsets[i] = full + place, capacity - free
    return bins, offsets


def pack_documents(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, group_docs: int = 8192) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens.

    Returns a row for each piece.  Every document has at least its end id, so a null
    or empty text is one piece of one token.  A very long text is tokenised whole and cut into
    pieces that are packed each by itself.  Repeated rows are packed each by itself; of
    equal sizes the smaller doc_id is placed first, null before all.  Other columns are
    ignored and an empty table gives no rows.  ``sequence_id`` holds the group in its upper
    bits and the group's own number of the sequence in the lower 32.

    A piece's group follows from its id and its place in its task's order by (id, text
    hash, start).  Only copies of one piece can change places in that order, so a task that
    runs again deals its pieces as before, whatever order its rows come in.
    """
    shared = share(docs, path)
    end = int(end_id).to_bytes(4, "little")

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        lexicon, packed, _, _ = shared.get()
        rows = []
        for doc_id, h, text in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strings(batch, "text"), strict=True):
            data = b"".join([*map(packed.__getitem__, lexicon.pieces(text)), end])
            total = len(data) // 4
            for start in range(0, total, length):
                piece = data[4 * start : 4 * (start + length)]
                rows.append((doc_id, h, start, len(piece) // 4, zlib.crc32(piece), total))
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([(name, "ascending") for name in ("doc_id", "deal", "start")])
        bins, offsets = first_fit_decreasing(group.column("length").to_pylist(), length)
        sequences = np.array(bins, np.int64) + (key[0].as_py() << 32)
        kept = group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return kept.append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets, pa.int64()))

    groups = max(1, -(-docs.count() // group_docs))
    texts = text_rows(docs).withColumn("h", F.xxhash64("text", F.col("text").isNull()))
    cut_up = map_batches(texts, pieces, PIECES).sortWithinPartitions("doc_id", "h", "start").withColumn("deal", F.monotonically_increasing_id())
    dealt = cut_up.withColumn("group", F.pmod(F.xxhash64("doc_id", "deal"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(pack, PACKED)
