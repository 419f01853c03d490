"""Versioned tables: readers see one version, retries change nothing, only touched buckets are written."""

import threading

import pytest
from pyspark.sql import functions as F

from assayflow.operators import knowledge
from assayflow.sources import versions

CHUNK = "content string, embedding array<double>, entity_id string, chunk_type string, source string, ord long"


def chunks(spark, rows):
    return spark.createDataFrame([(c, [1.0], e, t, s, o) for o, (c, e, t, s) in enumerate(rows)], CHUNK)


def stored(spark, path, manifest=None):
    return sorted((r["content"], r["entity_id"], r["chunk_type"], r["source"]) for r in versions.read_version(spark, path, manifest).collect())


def test_upserts_and_retries(spark, tmp_path):
    path = str(tmp_path / "knowledge")
    first = chunks(spark, [("a1", "a", "factual", "s"), ("a2", "a", None, "s"), ("b1", "b", None, None), ("x", None, None, "s"), ("a3", "a", None, "s")])
    assert knowledge.store_knowledge(path, first, 0) == 1
    one, rows = versions.current_version(path), stored(spark, path)
    assert [r[0] for r in rows] == ["a1", "a3", "b1", "x"] and rows[2][3] == "unknown" and len(rows[3][1]) == 32
    assert knowledge.store_knowledge(path, chunks(spark, [("a4", "a", None, "s"), ("c1", "c", None, "s")]), 1) == 2
    assert [r[0] for r in stored(spark, path)] == ["a1", "a4", "b1", "c1", "x"]
    assert stored(spark, path, one) == rows
    assert knowledge.store_knowledge(path, chunks(spark, [("no", "a", None, "s")]), 1) == 2  # made already
    assert [r[0] for r in stored(spark, path)] == ["a1", "a4", "b1", "c1", "x"]
    two = versions.current_version(path)
    assert sum(two["buckets"].get(b) != f for b, f in one["buckets"].items()) <= 2  # the others go on as they are
    assert knowledge.store_knowledge(path, first.limit(0)) == 3
    assert [r[0] for r in stored(spark, path)] == ["a1", "a4", "b1", "c1", "x"]
    assert versions.vacuum(path, keep=1) == 1 and [r[0] for r in stored(spark, path)] == ["a1", "a4", "b1", "c1", "x"]
    with pytest.raises(ValueError, match="key"):
        versions.upsert_version(path, first, ["entity_id"], lambda old, new: new)
    with pytest.raises(ValueError, match="keys"):
        versions.upsert_version(str(tmp_path / "other"), first, ["entity_id"], lambda old, new: new.withColumn("entity_id", F.concat("content", F.lit("?"))))
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, str(tmp_path / "nothing"))


def test_a_writer_that_comes_second(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([(1, "a")], "k long, v string")
    versions.upsert_version(path, rows, ["k"], lambda old, new: new)
    before = versions.current_version(path)
    versions.upsert_version(path, rows, ["k"], lambda old, new: new)
    monkeypatch.setattr(versions, "current_version", lambda p: before)
    with pytest.raises(RuntimeError, match="another writer"):
        versions.upsert_version(path, rows, ["k"], lambda old, new: new)


def test_a_reader_during_commits(spark, tmp_path):
    """Whenever a reader begins, it sees rows of one version and of one try of a batch, never a part or a mix."""
    table, batches, seen, over = str(tmp_path / "t"), str(tmp_path / "b"), [], threading.Event()
    replace = lambda old, new: new.unionByName(old.join(new.select("k"), "k", "left_anti"))
    rows = lambda v: spark.range(40).select(F.col("id").alias("k"), F.lit(v).alias("v")).repartition(4)
    versions.upsert_version(table, rows(0), ["k"], replace, n_buckets=4)
    versions.commit_batch(rows(0), batches, 7)

    def read():
        while not over.is_set():
            for df in (versions.read_version(spark, table), versions.read_batches(spark, batches)):
                seen.append([r["v"] for r in df.collect()])

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for v in range(1, 5):
            versions.upsert_version(table, rows(v), ["k"], replace, v)
            versions.commit_batch(rows(v), batches, 7)
    finally:
        over.set()
        reader.join()
    assert len(seen) > 4 and all(len(s) == 40 and len(set(s)) == 1 for s in seen)
    assert set(r["v"] for r in versions.read_batches(spark, batches).collect()) == {4}
    versions.commit_batch(rows(9), batches, 8)
    assert versions.read_batches(spark, batches).count() == 80 and versions.vacuum(batches) == 4
    assert versions.read_batches(spark, batches).count() == 80
