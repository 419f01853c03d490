"""Request limits by a scan of functions and over late streams, against a walk over each key's requests."""

import datetime as dt
import random

import numpy as np
import pytest

from assayflow.sources.shared import shared_path
from assayflow.streaming import limits, stateful

EPOCH = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, key long, ts timestamp"


def walked(rows, limit, window_s):
    """event_id -> (window start, number in it, allowed), one request after the other."""
    out, opened = {}, {}
    for i, key, ts in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[2], r[0])):
        start, n = opened.get(key, (None, 0))
        start, n = (ts, 1) if start is None or ts >= start + dt.timedelta(seconds=window_s) else (start, n + 1)
        opened[key] = start, n
        out[i] = start, n, n <= limit
    return out


def result(rows):
    return {r["event_id"]: (r["window_start"], r["n"], r["allowed"]) for r in rows}


@pytest.mark.parametrize("dense", [1, 6, 60])
def test_functions_of_pieces(dense):
    """Composed in any way, pieces leave the window open that a walk over all requests does."""
    rng = random.Random(dense)
    for _ in range(150):
        width = 100
        ts = np.cumsum([rng.choice((0, 1, rng.randrange(1, 200 // dense + 2))) for _ in range(rng.randrange(4, 60))]).astype(np.int64)
        edges = sorted({0, len(ts), *(rng.randrange(1, len(ts)) for _ in range(rng.randrange(1, 8)))})
        pieces = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at, start, n = limits.piece_function(ts[a:b], width)
            pieces.append({"size": b - a, "since": int(ts[a]), "upto": int(ts[b - 1]), "at": at.tobytes(), "start": start.tobytes(), "n": n.tobytes()})
        states, start, n = [], limits.NONE, 0
        for i, t in enumerate(ts.tolist()):
            if i in edges:
                states.append((start, n))
            start, n = (t, 1) if start == limits.NONE or t >= start + width else (start, n + 1)
        states.append((start, n))
        for a in range(len(pieces)):
            for b in range(a + 1, len(pieces) + 1):
                whole = limits.composed(pieces[a:b], width)
                assert limits.leave(*states[a], width, whole) == states[b]
                span = ts[(ts >= whole["since"]) & (ts <= whole["since"] + width)]
                assert len(limits.arrays(whole)[0]) <= len(np.unique(span)) + 1


def test_hot_key_in_many_ranges(spark, monkeypatch):
    """A key with most of the rows is in all ranges, over several levels of composition; others end and begin between."""
    rng = random.Random(1)
    rows, i = [], 0
    for key, n, gaps in ((5, 3000, (0, 0, 1, 3)), (1, 40, (0, 30, 61)), (9, 300, (59, 60, 61, 1)), (7, 1, (0,))):
        t = 0
        for _ in range(n):
            t += rng.choice(gaps)
            rows.append((i, key, EPOCH + dt.timedelta(seconds=t)))
            i += 1
    rows += [(i, None, EPOCH), (i + 1, 5, None)]
    rng.shuffle(rows)
    monkeypatch.setattr(limits, "FAN", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        for limit, window_s in ((3, 60), (2, 3000)):
            got = limits.rate_limit(spark.createDataFrame(rows, SCHEMA), limit, window_s)
            assert got.rdd.getNumPartitions() == 11
            assert result(got.collect()) == walked(rows, limit, window_s)
        plan = got._jdf.queryExecution().toString()
        assert "Window" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert limits.rate_limit(spark.createDataFrame([], SCHEMA)).count() == 0


def run(spark, tmp_path, batches, delay, limit=2, window_s=60):
    """What a stream of these micro-batches gives, and its last progress."""
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/b={k}"))
    stream = spark.readStream.schema(SCHEMA + ", b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get(stateful.STATE_STORE)
    spark.conf.set(stateful.STATE_STORE, stateful.ROCKS)
    out = str(tmp_path / "out")
    try:
        rows = limits.rate_limit_stream(stream, limit, window_s, delay)
        query = rows.writeStream.outputMode("append").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/k={k}")).option("checkpointLocation", shared_path(spark, "limits")).trigger(availableNow=True).start()
        query.awaitTermination()
        return result(spark.read.schema(limits.LIMITED).parquet(f"{out}/*").collect()), query.recentProgress
    finally:
        spark.conf.set(stateful.STATE_STORE, before)


def test_late_requests(spark, tmp_path):
    """Requests out of order over five micro-batches give the rows of the batch twin; then no state is left."""
    rng = random.Random(2)
    rows = [(i, rng.choice((1, 1, 1, 2, 3)), EPOCH + dt.timedelta(milliseconds=rng.randrange(600_000))) for i in range(400)]
    rows += [(1000, 1, rows[0][2]), (1001, 1, rows[0][2])]
    arrives = sorted(rows, key=lambda r: r[2] + dt.timedelta(milliseconds=(r[0] * 7919) % 100_000))
    batches = [arrives[k * 81 : (k + 1) * 81] for k in range(5)] + [[(-1, None, EPOCH + dt.timedelta(days=1))]]
    for a, b in zip(batches[:4], batches[1:5], strict=True):
        assert min(r[2] for r in b) < max(r[2] for r in a)
    got, progress = run(spark, tmp_path, batches, "100 seconds")
    assert got == walked(rows, 2, 60) == result(limits.rate_limit(spark.createDataFrame(rows, SCHEMA), 2, 60).collect())
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) > 0


def test_too_late_requests(spark, tmp_path):
    """A request is dropped where newer ones have been numbered; one before that counts, though it came after newer ones."""
    at = lambda s: EPOCH + dt.timedelta(seconds=s)
    batches = [[(1, 1, at(100))], [(2, 1, at(95)), (3, 2, at(300))], [(5, 1, at(292))], [(4, 1, at(101))], [(6, None, at(9999))]]
    got, _ = run(spark, tmp_path, batches, "10 seconds")
    assert got == walked([(1, 1, at(100)), (2, 1, at(95)), (3, 2, at(300)), (5, 1, at(292))], 2, 60)
