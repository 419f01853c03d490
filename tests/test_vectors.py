"""Exact vector search against a sort of all pairs."""

import math
import random

import numpy as np
import pytest

from assayflow.operators import vectors

SCHEMA = "vec array<double>"


def dot(a, b):
    """Summed up in order: sum() of floats isn't."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def nearest(queries, rows, k):
    """query_id -> its k (id, dist), each pair summed up in order."""
    out = {}
    for query, q in queries:
        found = []
        for i, v in rows:
            if q is None or v is None or len(q) != len(v) or None in q or None in v:
                continue
            norms = math.sqrt(dot(q, q)) * math.sqrt(dot(v, v))
            dist = math.nan if norms == 0 else 1 - dot(q, v) / norms
            found.append((True, 0.0, i) if math.isnan(dist) else (False, dist, i))
        out.setdefault(query, []).extend(found)
    return {q: [(i, None if none else d) for none, d, i in sorted(f)[:k]] for q, f in out.items() if f}


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], None if math.isnan(r["dist"]) else r["dist"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.fixture(scope="module")
def odd_vectors():
    rng = random.Random(4)
    vec = lambda n: [rng.choice((-1.0, 0.0, 0.5, 1.0)) if n < 5 else rng.gauss(0, 1) for _ in range(n)]
    rows = [(i, vec(8)) for i in range(300)] + [(300 + i, vec(3)) for i in range(60)]
    rows += [(400 + i, list(rows[i][1])) for i in range(0, 300, 3)]  # copies: ties
    rows += [(600 + i, [0.0] * 8) for i in range(9)] + [(700, None), (701, []), (702, [None] * 8), (703, [1.0, None, 2.0]), (704, [1e-200] * 8), (705, [1e200] * 8)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [7, 2000])
def test_vector_topk(spark, odd_vectors, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERIES", block)
    monkeypatch.setattr(vectors, "SCANS", 3)
    queries = [(i % 40, v) for i, v in odd_vectors[:30]] + [(900, [0.0] * 8), (901, [0.0] * 3), (902, None), (903, [1.0] * 99), (904, []), (905, [1.0, 1.0, 1.0])]
    q = spark.createDataFrame([*queries, queries[0], queries[0]], f"query_id long, {SCHEMA}")
    v = spark.createDataFrame(odd_vectors, f"id long, {SCHEMA}").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for k in (1, 5, 500):
            assert found(vectors.vector_topk(q, v, k)) == nearest(queries, odd_vectors, k)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    hits = vectors.vector_topk(q, v, 5)
    assert vectors.within_distance(hits).count() == sum(d is not None and d < 0.6 for f in nearest(queries, odd_vectors, 5).values() for _, d in f)


def test_vector_topk_of_texts_and_nothing(spark):
    v = spark.createDataFrame([(x, [1.0, 0.0]) for x in ("b", "a", "é", "Z")] + [("c", [0.0, 0.0])], f"id string, {SCHEMA}")
    q = spark.createDataFrame([("x", [2.0, 0.0])], f"query_id string, {SCHEMA}")
    assert found(vectors.vector_topk(q, v, 9)) == {"x": [("Z", 0.0), ("a", 0.0), ("b", 0.0), ("é", 0.0), ("c", None)]}
    assert vectors.vector_topk(q.limit(0), v).count() == 0 and vectors.vector_topk(q, v.limit(0)).count() == 0


def test_only_k_rows_a_query_leave_a_task(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(800, 4)))], f"id long, {SCHEMA}").repartition(4)
    q = v.where("id < 20").selectExpr("id AS query_id", "vec")
    hits = vectors.vector_topk(q, v, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BroadcastHashJoin" not in plan
    heaps = vectors.Heaps(rng.normal(size=(5, 4)), 3)
    for _ in range(10):
        heaps.see(rng.normal(size=(100, 4)), list(range(100)))
        assert len(heaps.ids) == 15
