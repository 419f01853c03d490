"""Approximate nearest neighbours: a forest of random-projection trees searched through one priority queue."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.llm.common import small

#: Trees; vectors of the sample that fits the splits, at most; of its vectors, those in a leaf at least.
TREES, SAMPLE, LEAF = 6, 20_000, 8
#: Queries, at most, whose exact answers say how many leaves to visit, and the share of their nearest rows that has to be found.
MEASURED, RECALL = 256, 0.95
#: Leaves below one node of this depth are searched in one group.
GROUPED = 5
#: Rows and queries that meet in one group at most about, so that a hot leaf is split.
ROWS_A_BLOCK, QUERIES_A_BLOCK = 4096, 1024


class Tree(NamedTuple):
    normals: np.ndarray  # inner nodes x dimensions, unit length; node i has children 2i + 1 and 2i + 2
    offsets: np.ndarray


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Split the sample at the median of a random projection, level by level."""
    n = (1 << depth) - 1
    normals = rng.standard_normal((n, sample.shape[1]))
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    offsets, node = np.zeros(n), np.zeros(len(sample), np.int64)
    for i in range(n):
        own = np.flatnonzero(node == i)
        if len(own):
            p = sample[own] @ normals[i]
            offsets[i] = np.median(p)
            node[own] = 2 * i + 1 + (p > offsets[i])
    return Tree(normals, offsets)


def fit_forest(vectors: DataFrame, n: int, trees: int = TREES, sample: int = SAMPLE) -> list[Tree]:
    """Fit on at most `sample` of the n vectors(id, vec), those of least hash of vector and id, as deep as LEAF lets the sample go."""
    h = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30))
    near = vectors.where(h < int(min(1.0, 1.2 * sample / max(n, 1)) * (1 << 30)))  # so that few have to be ordered
    rows = np.array([r["vec"] for r in near.orderBy(h, "id").limit(sample).select("vec").collect()], np.float64)
    if not len(rows):
        rows = np.zeros((1, 1))
    rows = rows[np.lexsort(rows.T)]
    rng = np.random.default_rng(11)
    return [grow(rows, int(math.log2(len(rows) / LEAF)) if len(rows) > LEAF else 0, rng) for _ in range(trees)]


def leaves(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    """Vectors x trees: the leaf of each."""
    out = np.zeros((len(x), len(forest)), np.int64)
    for t, tree in enumerate(forest):
        node = np.zeros(len(x), np.int64)
        while len(tree.offsets) and node.min(initial=len(tree.offsets)) < len(tree.offsets):
            node = 2 * node + 1 + ((x * tree.normals[node]).sum(axis=1) > tree.offsets[node])
        out[:, t] = node - len(tree.offsets)
    return out


def visits(forest: list[Tree], q: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The first n leaves of all trees, by the squared margins crossed on the way: one queue serves all trees."""
    margins = [tree.normals @ q - tree.offsets for tree in forest]
    queue = [(0.0, t, 0) for t in range(len(forest))]
    found: list[tuple[int, int]] = []
    while queue and len(found) < n:
        crossed, t, i = heapq.heappop(queue)
        if i >= len(margins[t]):
            found.append((t, i - len(margins[t])))
            continue
        m = float(margins[t][i])
        near = 2 * i + 1 + (m > 0)
        heapq.heappush(queue, (crossed, t, near))
        heapq.heappush(queue, (crossed + m * m, t, 4 * i + 3 - near))
    return found


def places(forest: list[Tree], q: np.ndarray) -> np.ndarray:
    """Trees x leaves: the place of each leaf in visits() of all leaves. A leaf comes by the squared margins on its way, then by tree and number."""
    crossed = []
    for tree in forest:
        margin = tree.normals @ q - tree.offsets
        level = np.zeros(1)
        while len(level) <= len(margin):
            m = margin[len(level) - 1 : 2 * len(level) - 1]
            right = m > 0
            level = np.stack([level + np.where(right, m * m, 0), level + np.where(right, 0, m * m)], axis=1).ravel()
        crossed.append(level)
    order = np.argsort(np.concatenate(crossed), kind="stable")
    out = np.empty(len(order), np.int32)
    out[order] = np.arange(len(order))
    return out.reshape(len(forest), -1)


class Exact:
    """The k nearest rows seen so far of each of some queries, and the least place of a leaf that holds the row in the query's visits."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, place: np.ndarray, k: int):
        self.ids, self.q, self.place, self.k = ids, q, place, k
        self.square, self.worst = (q * q).sum(axis=1), np.full(len(q), np.inf)
        self.found = np.empty((0, 3))  # query, distance, place
        self.rows = np.empty(0, np.int64)

    def see(self, ids: np.ndarray, x: np.ndarray, own: np.ndarray) -> None:
        square = (x * x).sum(axis=1)
        rough = self.square[:, None] + square - 2 * (self.q @ x.T)
        bound = self.worst**2
        if len(ids) > 2 * self.k:  # one of them may be the query itself, and others may repeat an id
            bound = np.minimum(bound, np.partition(rough, 2 * self.k, axis=1)[:, 2 * self.k]) if len(np.unique(ids)) == len(ids) else bound
        near = rough <= (bound + 1e-9 * (1 + self.square + square.max(initial=0)))[:, None]
        query, row = np.nonzero(near & (ids != self.ids[:, None]))
        diff = self.q[query] - x[row]
        place = self.place[query[:, None], np.arange(own.shape[1]), own[row]].min(axis=1)
        found = np.concatenate([self.found, np.stack([query, np.sqrt((diff * diff).sum(axis=1)), place], axis=1)])
        rows = np.concatenate([self.rows, ids[row]])
        # An id counts once for a query, at its least distance and place; then the k nearest stay.
        order = np.lexsort((found[:, 2], found[:, 1], rows, found[:, 0]))
        first = order[np.flatnonzero(np.append(True, (np.diff(found[order, 0]) != 0) | (np.diff(rows[order]) != 0)))] if len(order) else order
        first = first[np.lexsort((rows[first], found[first, 1], found[first, 0]))]
        begin = np.searchsorted(found[first, 0], np.arange(len(self.q)))
        rank = np.arange(len(first)) - begin[found[first, 0].astype(int)]
        keep = first[rank < self.k]
        self.found, self.rows = found[keep], rows[keep]
        full = first[rank == self.k - 1]
        self.worst[found[full, 0].astype(int)] = found[full, 1]


def leaves_to_visit(rows: DataFrame, forest: list[Tree], every: int, k: int) -> int:
    """How many leaves a query visits: as many as find RECALL of the k nearest of MEASURED queries, by their exact answers among all rows(id, vec).

    The queries measured are those of least hash of id, all if they are fewer. Their answers take one pass over the rows, in which a
    task keeps k rows a query, and so do tasks the answers of different rows; a small table comes back.
    """
    asked = rows.where(F.col("id") % every == 0).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(MEASURED).collect()
    if not asked:
        return 1
    ids, q = np.array([r["id"] for r in asked], np.int64), np.array([r["vec"] for r in asked], np.float64)
    shared = rows.sparkSession.sparkContext.broadcast((forest, ids, q, np.stack([places(forest, v) for v in q])))

    def see(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, of, vectors, place = shared.value
        best = Exact(of, vectors, place, k)
        for f in frames:
            if len(f):
                x = np.stack(f["vec"].to_numpy())
                best.see(f["id"].to_numpy(), x, leaves(trees, x))
        yield pd.DataFrame({"query": best.found[:, 0].astype(int), "id": best.rows, "score": best.found[:, 1], "place": best.found[:, 2].astype(int)})

    each = rows.mapInPandas(see, "query int, id long, score double, place int").groupBy("query", "id").agg(F.min("score").alias("score"), F.min("place").alias("place"))
    order = Window.partitionBy("query").orderBy("score", "id")
    found = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("place").collect()  # k * MEASURED rows
    place = sorted(r["place"] for r in found)
    return place[math.ceil(RECALL * len(place)) - 1] + 1 if place else 1


def nearest(ids: np.ndarray, x: np.ndarray, square: np.ndarray, own: int, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the k rows of x nearest to y, without those of the query's own id.

    Products tell which rows can be among them; only those are measured in full.
    """
    there = float(y @ y)
    rough = square + there - 2 * (x @ y)
    rough[ids == own] = np.inf
    most = min(k, len(rough)) - 1
    kth = np.partition(rough, most)[most]
    near = np.flatnonzero((rough <= kth + 1e-9 * (1 + there + square.max())) & (ids != own))
    diff = x[near] - y
    d = np.sqrt((diff * diff).sum(axis=1))
    order = np.lexsort((ids[near], d))[:k]
    return ids[near][order], d[order]


def once(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that repeat an id, the one that is nearest to y."""
    order = np.lexsort((((x - y) ** 2).sum(axis=1), ids))
    order = order[np.flatnonzero(np.diff(ids[order], prepend=np.iinfo(np.int64).min))]
    return ids[order], x[order]


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `every`.

    Candidates are all other usable rows of the dimension that most rows have (the smaller of equal ones);
    null ids take no part. The forest is fitted on a bounded sample; every row is put into a leaf of every
    tree. How many leaves a query visits follows from the recall that is measured on this table (leaves_to_visit), at every size alike. Leaves and queries meet in groups, below a node and in blocks of bounded size, where the exact
    Euclidean distance in double precision ranks the rows of the leaves that a query visits; so a leaf full of
    equal vectors is many tasks. Ties go to the smaller id. Repeated ids are one candidate, at their smallest distance.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    rows = rows.where(F.size("vec") == (sizes[0]["d"] if sizes else 0))
    forest = fit_forest(rows, sizes[0]["n"] if sizes else 0)
    shared = vectors.sparkSession.sparkContext.broadcast(forest)
    a_tree = len(forest[0].offsets) + 1
    budget = leaves_to_visit(rows, forest, every, k)
    below = max(1, a_tree >> GROUPED)  # leaves of a group

    def to_leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                own = leaves(shared.value, np.stack(f["vec"].to_numpy()))
                n, trees = own.shape
                leaf = own.ravel()
                yield pd.DataFrame({"tree": np.tile(np.arange(trees), n), "part": leaf // below, "id": np.repeat(f["id"].to_numpy(), trees), "vec": np.repeat(f["vec"].to_numpy(), trees), "leaves": list(leaf[:, None])})

    def to_visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for i, v in zip(f["id"], f["vec"], strict=True):
                parts: dict[tuple[int, int], list[int]] = {}
                for t, x in visits(shared.value, np.asarray(v), budget):
                    parts.setdefault((t, x // below), []).append(x)
                found += [(t, part, i, v, sorted(own)) for (t, part), own in parts.items()]
            yield pd.DataFrame(found, columns=["tree", "part", "id", "vec", "leaves"])

    placed = "tree int, part int, id long, vec array<double>, leaves array<int>"
    index = rows.mapInPandas(to_leaves, placed)
    asked = rows.where(F.col("id") % every == 0).mapInPandas(to_visits, placed)
    # The forest bounds the number of groups, so these counts are a small table.
    per_part = index.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    per_visit = asked.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("m"))
    parts = per_part.join(per_visit, ["tree", "part"]).select("tree", "part", F.ceil(F.col("n") / ROWS_A_BLOCK).cast("int").alias("row_parts"), F.ceil(F.col("m") / QUERIES_A_BLOCK).cast("int").alias("query_parts"))
    parts = small(parts, max_rows=1 << 16)

    def dealt(df: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        j = df.join(parts, ["tree", "part"]).withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        r, q = ("theirs", "mine") if is_query else ("mine", "theirs")
        return j.select("tree", "part", F.col(r).alias("row_part"), F.col(q).alias("query_part"), "id", "vec", "leaves", F.lit(is_query).alias("is_query"))

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        q, v = f[f["is_query"]], f[~f["is_query"]]
        out = []
        if len(q) and len(v):
            leaf = np.array([x[0] for x in v["leaves"]])
            order = np.argsort(leaf, kind="stable")
            leaf, ids, x = leaf[order], v["id"].to_numpy()[order], np.stack(v["vec"].to_numpy())[order]
            square = (x * x).sum(axis=1)
            single = len(np.unique(ids)) == len(ids)
            for i, y, own in zip(q["id"].to_numpy(), q["vec"].to_numpy(), q["leaves"], strict=True):
                rows_of = np.concatenate([np.arange(a, b) for a, b in zip(np.searchsorted(leaf, own), np.searchsorted(leaf, own, "right"), strict=True)])
                if not len(rows_of):
                    continue
                if single:
                    near, d = nearest(ids[rows_of], x[rows_of], square[rows_of], i, y, k)
                else:
                    own_ids, own_x = once(ids[rows_of], x[rows_of], y)
                    near, d = nearest(own_ids, own_x, (own_x * own_x).sum(axis=1), i, y, k)
                out.append(pd.DataFrame({"query_id": i, "vec_id": near, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    both = dealt(index, "row_parts", "query_parts", False).unionByName(dealt(asked, "query_parts", "row_parts", True))
    met = both.groupBy("tree", "part", "row_part", "query_part").applyInPandas(meet, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
