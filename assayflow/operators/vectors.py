"""Exact retrieval by vector distance: blocks of queries against all rows as matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayflow.sources.shared import read_block, write_blocks

#: Queries of a block, rows that meet a block at a time, and scans of the rows at most, each for its share of the blocks.
QUERIES, ROWS, SCANS = 2_000, 2_000, 64
#: The matrix product tells candidates only; they are summed up again in order. Its error in a distance is far below this.
MARGIN = 1e-9
#: Products of norms below this are no base for the product's error: such pairs are always summed up.
TINY = 1e-250


def arrays_by_length(vecs: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their length: their places and a matrix. Null vectors and those with a null component are left out."""
    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    offsets, values = vecs.offsets.to_numpy(), vecs.values
    lengths = np.diff(offsets)
    holes = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    whole = vecs.is_valid().to_numpy(zero_copy_only=False) & (holes[offsets[1:]] == holes[offsets[:-1]])
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    out = {}
    for n in np.unique(lengths[whole]).tolist():
        rows = np.flatnonzero(whole & (lengths == n))
        out[n] = rows, flat[offsets[rows][:, None] + np.arange(n)]
    return out


def norms(m: np.ndarray) -> np.ndarray:
    """Square roots of the sums of squares, summed up in order."""
    total = np.zeros(len(m))
    with np.errstate(over="ignore"):
        for column in m.T:
            total += column * column
    return np.sqrt(total)


def distances(q: np.ndarray, v: np.ndarray, qn: np.ndarray, vn: np.ndarray) -> np.ndarray:
    """Cosine distance of pairs of rows, summed up in order, so that equal vectors are at equal distances; NaN for zero vectors."""
    dot = np.zeros(len(q))
    for a, b in zip(q.T, v.T, strict=True):
        dot += a * b
    both = qn * vn
    return np.where(both == 0, np.nan, 1 - dot / np.where(both == 0, 1, both))


class Heaps:
    """The k nearest rows found so far for each query of a block, ties to the smaller id, NaN last."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.qn, self.k = q, norms(q), k
        self.query, self.dist, self.ids = np.empty(0, np.int64), np.empty(0), []
        self.worst = np.full(len(q), np.inf)  # distance of the k-th nearest

    def see(self, v: np.ndarray, ids: list) -> None:
        vn = norms(v)
        with np.errstate(all="ignore"):
            both = np.outer(self.qn, vn)
            near = 1 - (self.q @ v.T) / both
            near[both == 0] = np.inf
            near[(both != 0) & ~((both > TINY) & np.isfinite(near))] = -np.inf
            bound = self.worst
            if v.shape[0] > self.k:
                bound = np.minimum(bound, np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + MARGIN)
            query, row = np.nonzero((near <= bound[:, None] + MARGIN) & (both != 0))
            dist = distances(self.q[query], v[row], self.qn[query], vn[row])
        # Pairs with a zero vector, if the other is finite, are at NaN, and of those only the k smallest ids can count.
        first = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])), np.int64)
        short = np.flatnonzero(np.isinf(self.worst))
        own = self.qn[short]
        for zero, some in ((short[own == 0], first[np.isfinite(vn[first])]), (short[(own != 0) & np.isfinite(own)], first[vn[first] == 0])):
            query, row = np.append(query, np.repeat(zero, min(self.k, len(some)))), np.append(row, np.tile(some[: self.k], len(zero)))
        dist = np.append(dist, np.full(len(query) - len(dist), np.nan))
        if len(query):
            self.merge(query, dist, [ids[i] for i in row.tolist()])

    def merge(self, query: np.ndarray, dist: np.ndarray, ids: list) -> None:
        query, dist, ids = np.append(self.query, query), np.append(self.dist, dist), self.ids + ids
        value = np.array(ids) if all(type(i) is int for i in ids) else self.ranked(ids)
        order = np.lexsort((value, np.where(np.isnan(dist), np.inf, dist), np.isnan(dist), query))
        query = query[order]
        begin = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        keep = order[place < self.k]
        self.query, self.dist, self.ids = query[place < self.k], dist[keep], [ids[i] for i in keep.tolist()]
        full = place == self.k - 1
        last = dist[order[full]]
        self.worst[query[full]] = np.where(np.isnan(last), np.inf, last)

    @staticmethod
    def ranked(ids: list) -> np.ndarray:
        place = {x: i for i, x in enumerate(sorted(set(ids), key=lambda x: (x is not None, x)))}
        return np.array([place[i] for i in ids])


def vector_topk(queries: DataFrame, knowledge: DataFrame, k: int | None = 5) -> DataFrame:
    """query_id, id, dist, rank: the k rows of least cosine distance for each query, ties to the smaller id.

    queries(query_id, vec), knowledge(id, vec). Zero vectors are at distance NaN, last. Null vectors, those that hold a
    null, and pairs of different lengths are at no distance and left out; a row that repeats a query's id and vector
    counts once. A stated set of queries meets all rows: queries are stored in blocks, and each task that scans rows
    multiplies its blocks with some rows at a time and keeps k rows a query. Rows are read where they are, without a shuffle,
    by one scan or, for many blocks, by several scans with their shares; only k rows a query and task are shuffled.
    """
    k = k or 5
    q = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull()).distinct()
    v = knowledge.select("id", F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    blocks = max(1, -(-q.count() // QUERIES))
    path = write_blocks(q.withColumn("block", F.pmod(F.xxhash64("query_id", "vec"), F.lit(blocks)).cast("int")), "block", blocks, "topk-queries")
    schema = q.select("query_id").schema.add(v.schema["id"]).add("dist", "double")

    def scan(own: list[int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heaps = None
            for batch in batches:
                if heaps is None:  # for each block and length of vectors: the queries' ids and heaps
                    heaps = []
                    for no in own:
                        block = read_block(path, "block", no)
                        if block is not None:
                            heaps += [(n, block.column("query_id").take(pa.array(rows)), Heaps(m, k)) for n, (rows, m) in arrays_by_length(block.column("vec")).items()]
                for n, (rows, m) in arrays_by_length(batch.column("vec")).items():
                    ids = batch.column("id").take(pa.array(rows)).to_pylist()
                    for length, _, heap in heaps:
                        if length == n:
                            for at in range(0, len(ids), ROWS):
                                heap.see(m[at : at + ROWS], ids[at : at + ROWS])
            for _, query_ids, heap in heaps or ():
                found = query_ids.take(pa.array(heap.query))
                yield pa.RecordBatch.from_arrays([found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found, pa.array(heap.ids, batch.schema.field("id").type), pa.array(heap.dist)], names=["query_id", "id", "dist"])

        return v.mapInArrow(run, schema)

    shares = min(blocks, SCANS)
    hits = reduce(DataFrame.unionByName, [scan(list(range(s, blocks, shares))) for s in range(shares)])
    order = Window.partitionBy("query_id").orderBy("dist", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def within_distance(hits: DataFrame, most: float = 0.6) -> DataFrame:
    """Hits nearer than `most`, after the limit: fewer than k may stay. NaN never does."""
    return hits.where((F.col("dist") < most) & ~F.isnan("dist"))
