"""Exact top-k inner products by no-random-access aggregation.

Vectors are dealt into candidate blocks, queries into query blocks, and each pair of
blocks meets in one task.  There, every component has a list of the block's vectors in
the order of its value.  A query reads its lists from their best end, step by step and
all to the same depth; a list of weight zero is not read.  What has been read gives each
vector a lower bound (unread components at their list's worst) and an upper bound
(unread components at the reading place).  Reading stops when all but k vectors have an
upper bound below the k-th best lower bound, or too few are left to read on for them; the
scores of those left are then resolved.  At the lists' end both bounds are the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block: what one task holds.
CANDIDATES, QUERIES = 8192, 1024
#: Queries bounded at once, and the share of what is unread that each step reads.
TOGETHER, STEP = 128, 0.5


class Lists:
    """A block's vectors with their sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[self.order], np.ascontiguousarray(vectors[self.order])
        self.values = np.sort(self.vectors, axis=0)  # of each component its list, ascending
        self.depths: list[float] = []  # the share of the lists that each query has read
        self.first = 0  # depth at which a query of the last lot stopped; no bounds are taken before it

    def top(self, queries: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query the k best of the block as (score, row in ``ids``), ties to the smaller id."""
        out: list[list[tuple[int, int]]] = []
        for begin in range(0, len(queries), TOGETHER):
            out += self._top(queries[begin : begin + TOGETHER], k)
        return out

    def _top(self, queries: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        n = len(self.ids)
        few = max(8 * k, n // 64)
        kept: list[np.ndarray] = [np.arange(n)] * len(queries)  # vectors that can still be among the k best
        depth, stops, waiting = 0, [], np.arange(len(queries))
        while len(waiting):
            depth = min(n, max(self.first, depth + max(1, int((n - depth) * STEP))))
            low, high = self._bounds(queries[waiting], depth)
            bar = np.partition(low, n - k, axis=1)[:, n - k] if n > k else low.min(axis=1)
            # A vector in no read part has the sum of the reading places as its upper bound and goes like any other.
            left = high >= bar[:, None]
            stop = (left.sum(axis=1) <= few) | (depth == n)
            for i in np.flatnonzero(stop):
                kept[waiting[i]] = np.flatnonzero(left[i])
            stops += [depth] * int(stop.sum())
            waiting = waiting[~stop]
        self.first = min(stops)
        self.depths += [x / n for x in stops]
        return [self.resolved(q, rows, k) for q, rows in zip(queries, kept, strict=True)]

    def _kind(self, queries: np.ndarray) -> type:
        """Floating point where every product and sum is exact in it, else whole numbers of any size."""
        bits = sum(int(np.abs(x.astype(np.float64)).max(initial=0)).bit_length() for x in (self.vectors, queries, np.array([queries.shape[1]])))
        return np.float64 if bits <= 52 else object

    def _bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, queries x vectors, once ``depth`` entries of each list are read.

        A positive weight reads its list from the upper end, a negative one from the lower.
        A value that the reading place has passed is known; another one counts as the list's
        far end for the lower bound and as the reading place for the upper bound.
        """
        v, kind = self.vectors, self._kind(queries)
        top, bottom = self.values[len(v) - depth], self.values[depth - 1]
        from_top, from_bottom = v >= top, v <= bottom
        up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)

        def bound(unread_top: np.ndarray, unread_bottom: np.ndarray) -> np.ndarray:
            return up @ np.where(from_top, v, unread_top).T.astype(kind) + down @ np.where(from_bottom, v, unread_bottom).T.astype(kind)

        return bound(self.values[0], self.values[-1]), bound(top, bottom)

    def resolved(self, query: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best of the rows by their whole scores; rows are in the order of ids."""
        kind = np.int64 if self._kind(query[None]) is np.float64 else object
        scores = self.vectors[rows].astype(kind) @ query.astype(kind)
        if len(rows) > k:
            fine = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
            rows, scores = rows[fine], scores[fine]
        best = np.argsort(-scores, kind="stable")[:k]
        return [(int(scores[i]), int(rows[i])) for i in best]


def whole_numbers(column: Column) -> Column:
    """floor(1024 x) of each component as long; null for a vector that takes no part.

    A vector takes no part if it is null or holds a null, an infinity or a NaN.
    """
    x = F.transform(column, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(column.isNotNull() & fine, F.transform(x, lambda v: F.floor(v * 1024)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k candidates of highest integer inner product for each query row.

    ``vectors``: vec_id and embedding.  Every row but the query's own is a candidate, also
    another row of the query's vec_id; equal vectors and repeated rows stay apart and rank
    by vec_id, and each of several query rows of one vec_id gets its own answer.  Vectors of
    different lengths do not meet.  Rows with a null vec_id take no part.  A component or
    a score beyond a long counts as the largest or smallest long.  Other columns are ignored.
    Returns query_id, rank (from 1), vec_id and score; a query with fewer candidates gets
    them all, an empty table gives no rows.

    Repeated rows are one row with a count from the start, so no block holds them all.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v"), is_query.alias("q"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id", "v").agg(F.bool_or("q").alias("q"), F.count("*").alias("n"))
    rows = rows.withColumns({"dims": F.size("v"), "h": F.xxhash64("v")})
    counts = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks, query_blocks = max(1, -(-counts["n"] // CANDIDATES)), max(1, -(-counts["q"] // QUERIES))
    block = F.pmod(F.xxhash64("vec_id", "h"), F.lit(blocks))
    query_block = F.pmod(F.xxhash64("vec_id", "h", F.lit(1)), F.lit(query_blocks))
    fields = ["dims", "vec_id", "v", "h", "n"]
    candidates = rows.select(*fields, block.alias("block"), F.explode(F.expr(f"sequence(0L, {query_blocks - 1}L)")).alias("query_block"))
    queries = rows.where("q").select(*fields, query_block.alias("query_block"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"))
    names = ["query_id", "qh", "times", "vec_id", "score", "n"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, ...]] = []
        if left.num_rows and right.num_rows:
            dims = left.column("dims")[0].as_py()

            def parts(table: pa.Table) -> tuple[np.ndarray, ...]:
                flat = table.column("v").combine_chunks().flatten().to_numpy()
                return flat.reshape(table.num_rows, dims), *(table.column(c).to_numpy() for c in ("vec_id", "h", "n"))

            (vectors, ids, hashes, counts), (asked, names_, own, times) = parts(left), parts(right)
            lists = Lists(ids, vectors)
            hashes, counts = hashes[lists.order], counts[lists.order]
            for i, best in enumerate(lists.top(asked, k + 1)):
                for score, row in best:
                    n = int(counts[row]) - bool(lists.ids[row] == names_[i] and hashes[row] == own[i])
                    if n:
                        out.append((int(names_[i]), int(own[i]), int(times[i]), int(lists.ids[row]), min(max(score, -(2**63)), 2**63 - 1), min(n, k)))
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    keys = ["dims", "block", "query_block"]
    best = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, ", ".join(f"{n} long" for n in names))
    place = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    each = best.select("query_id", "qh", "times", "vec_id", "score", F.explode(F.expr("sequence(1L, n)")).alias("copy"))
    ranked = each.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.expr("sequence(1L, times)")).alias("copy")).drop("copy")
