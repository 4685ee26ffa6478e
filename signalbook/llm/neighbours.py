"""Exact nearest neighbours as a block matrix join with int8 tiles and error bounds.

Every vector is kept as int8 codes with a scale of its own and the exact norm of what the codes leave out.
A tile multiplies the codes of a block of queries with those of a block of vectors; by the triangle inequality

    | |x - y| - |x' - y'| | <= |x - x'| + |y - y'|

the tile gives a lower and an upper bound on every distance. Vectors whose lower bound is above the k-th
smallest upper bound cannot be among the k nearest; the others are computed again in double precision on the
original vectors and go through a heap per query. Lists of different blocks are merged by heaps as well.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 512
VECTOR_BLOCK = 4096
SPANS, SPAN_ROWS = 64, 100_000  # parts of the vectors at least, and rows of a part


def usable(vector: str = "embedding") -> Column:
    """True for vectors that take part: not null, not empty, not zero, all components finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def quantize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and an upper bound of the norms of the residuals."""
    scale = np.abs(x).max(1) / 127.0
    scale[scale == 0] = 1.0  # of components too small to be divided
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    residual = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))
    return codes, scale, residual * (1 + 1e-9)


def tile_bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of two quantized blocks."""
    # float64 holds int8 products of any practical width exactly and runs on the matrix unit
    dots = q[0].astype(np.float64) @ c[0].astype(np.float64).T
    nq = (q[0].astype(np.float64) ** 2).sum(1) * q[1] ** 2
    nc = (c[0].astype(np.float64) ** 2).sum(1) * c[1] ** 2
    squared = nq[:, None] + nc[None, :] - 2 * dots * (q[1][:, None] * c[1][None, :])
    slack = 1e-12 * (nq[:, None] + nc[None, :])  # rounding of the line above
    error = q[2][:, None] + c[2][None, :]
    low = np.sqrt(np.maximum(squared - slack, 0)) - error
    high = np.sqrt(np.maximum(squared, 0) + slack) + error
    return low * (1 - 1e-12), high * (1 + 1e-12)


def _stack(rows: list[list[float]]) -> np.ndarray:
    return np.array(rows, np.float64).reshape(len(rows), -1)


class _Search:
    """Heaps of the k nearest per query of one block, fed with blocks of vectors."""

    def __init__(self, ids: list[int], vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.codes = quantize(vectors)
        self.heaps: list[list] = [[] for _ in ids]  # (-distance, -id): the worst on top

    def feed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if vectors.shape[1] != self.vectors.shape[1]:
            return
        low, high = tile_bounds(self.codes, quantize(vectors))
        for row, query in enumerate(self.ids):
            heap, k = self.heaps[row], self.k
            own = ids == query
            upper = np.where(own, np.inf, high[row])
            limit = np.partition(upper, k - 1)[k - 1] if len(upper) > k else np.inf
            if len(heap) == k:
                limit = min(limit, -heap[0][0])
            near = np.flatnonzero((low[row] <= limit) & ~own)
            if not len(near):
                continue
            difference = vectors[near] - self.vectors[row]
            distance = np.sqrt((difference * difference).sum(1))
            best = np.lexsort((ids[near], distance))[:k]
            for d, i in zip(distance[best].tolist(), ids[near][best].tolist()):
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -i))
                elif (-d, -i) > heap[0]:
                    heapq.heapreplace(heap, (-d, -i))
                else:
                    break


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
    query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK, spans: int | None = None,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest vectors of every query, nearest first.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. A query is not its own
    candidate; rows that repeat an id count once (the smallest vector, component by component). Vectors that are null, empty, zero
    or hold null or non-finite components take no part, neither as queries nor as candidates; vectors of
    another width than a query's are no candidates of it. An empty table on either side gives no rows.

    Queries are cut into blocks, vectors into ``spans`` parts (by their number, if not given), and every block meets every part once: that is
    the work asked for, a stated set of queries against all rows. A task holds one block of queries, one
    block of vectors and k entries per query. Each part sends k rows per query to the merge.
    """
    of = lambda df: df.filter(usable(vector)).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    once = lambda df: df.groupBy("id").agg(F.min("v").alias("v"))
    left, right = once(of(queries)), once(of(vectors))
    spans = spans or max(SPANS, -(-vectors.count() // SPAN_ROWS))
    # Blocks by a hash of the id: how many there are follows the number of queries, which is counted.
    blocks = max(1, -(-left.count() // query_block))
    span = F.pmod(F.xxhash64("id"), F.lit(spans)).cast("int")
    left = left.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int"))
    sent = left.select("block", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"), F.lit(0).alias("side"), "id", "v")
    dealt = right.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), span.alias("span"), F.lit(1).alias("side"), "id", "v")
    work = sent.unionByName(dealt).repartition("block", "span").sortWithinPartitions("block", "span", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, search, ids, rows, open_ids, open_rows = None, [], [], [], [], []

        def start() -> None:
            by_width: dict[int, list[int]] = {}
            for n, r in enumerate(open_rows):
                by_width.setdefault(len(r), []).append(n)
            search[:] = [_Search([open_ids[n] for n in ns], _stack([open_rows[n] for n in ns]), k) for ns in by_width.values()]
            open_ids.clear()
            open_rows.clear()

        def feed() -> None:
            by_width: dict[int, list[int]] = {}
            for n, r in enumerate(rows):
                by_width.setdefault(len(r), []).append(n)
            for ns in by_width.values():
                block = np.array([ids[n] for n in ns], np.int64), _stack([rows[n] for n in ns])
                for s in search:
                    s.feed(*block)
            ids.clear()
            rows.clear()

        def results() -> pa.RecordBatch:
            out = [(q, -i, -d) for s in search for q, heap in zip(s.ids, s.heaps) for d, i in heap]
            search.clear()
            columns = list(zip(*out)) or [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "span", "side", "id", "v"))):
                if row[:2] != group:
                    feed()
                    yield results()
                    group = row[:2]
                    open_ids.clear()
                    open_rows.clear()
                if row[2] == 0:
                    open_ids.append(row[3])
                    open_rows.append(row[4])
                    continue
                if open_rows:
                    start()
                ids.append(row[3])
                rows.append(row[4])
                if len(rows) >= vector_block:
                    feed()
        feed()
        yield results()

    parts = work.mapInArrow(run, "query_id long, vec_id long, score double")
    return _merged(parts, k)


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The k best of the lists of each query, by a heap that never holds more than k entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap, out = None, [], []

        def close() -> None:
            for rank, (d, i) in enumerate(sorted((-d, -i) for d, i in heap), 1):
                out.append((query, rank, i, d))
            heap.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["query_id", "rank", "vec_id", "score"])
            out.clear()
            return made

        for batch in batches:
            for q, i, d in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score"))):
                if q != query:
                    close()
                    query = q
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -i))
                elif (-d, -i) > heap[0]:
                    heapq.heapreplace(heap, (-d, -i))
            yield batch_of()
        close()
        yield batch_of()

    return parts.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(
        run, "query_id long, rank int, vec_id long, score double")
