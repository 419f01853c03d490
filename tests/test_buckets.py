"""Streams keep a state for each bucket of keys, not for each key, and give the rows of the batch form."""

import datetime as dt

from pyspark.sql import functions as F

from assayflow.streaming import buckets, limits, stateful

EPOCH = dt.datetime(2024, 1, 1)


def rows_of_state(spark, tmp_path, monkeypatch, df, streamed):
    """All output over two micro-batches, and the most rows of state that there were."""
    monkeypatch.setattr(buckets, "BUCKETS", 2)
    for k in range(2):
        df.where(F.col("part") == k).coalesce(1).write.parquet(str(tmp_path / f"in/b={k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    most, out = [], str(tmp_path / "out")
    before = spark.conf.get(stateful.STATE_STORE)
    spark.conf.set(stateful.STATE_STORE, stateful.ROCKS)
    try:
        query = streamed(stream).writeStream.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/k={k}")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        most = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
    finally:
        spark.conf.set(stateful.STATE_STORE, before)
    return spark.read.parquet(f"{out}/*"), most


def test_limits(spark, tmp_path, monkeypatch):
    rows = [(i if i else None, i % 50, EPOCH + dt.timedelta(seconds=i), int(i >= 150)) for i in range(300)]
    rows += [((1 << 60) + 1, 7, EPOCH + dt.timedelta(seconds=400), 1)]  # an id that no double holds, beside a null one
    df = spark.createDataFrame(rows, "event_id long, key long, ts timestamp, part int")
    out, most = rows_of_state(spark, tmp_path, monkeypatch, df.unionByName(spark.createDataFrame([(0, None, EPOCH + dt.timedelta(days=1), 1)], df.schema)), lambda s: limits.rate_limit_stream(s, 2, 120, "100 seconds"))
    both = [sorted(map(str, d.select("event_id", "key", "ts", "window_start", "n", "allowed").collect())) for d in (out, limits.rate_limit(df, 2, 120))]
    assert both[0] == both[1] and 0 < most < 50


def test_cached(spark, tmp_path, monkeypatch):
    rows = [(i % 50, f"d{i}", EPOCH + dt.timedelta(seconds=i), 60 if i % 50 == 3 else 9999, int(i >= 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "job_id long, doc string, written_at timestamp, ttl_sec int, part int")
    out, most = rows_of_state(spark, tmp_path, monkeypatch, df, lambda s: stateful.latest_cached_stream(s, "0 seconds"))
    live = {(r["job_id"], r["doc"]) for r in out.where("live").collect()}
    assert live == {(k, f"d{k + n}") for k in range(50) for n in (50, 150)} and out.where("live").count() == 100
    assert [(r["job_id"], r["doc"]) for r in out.where("NOT live").collect()] == []  # 3's last document lives until second 213
    assert 0 < most < 50
