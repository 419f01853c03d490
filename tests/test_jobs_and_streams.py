"""Job tables, and streams against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assayflow.operators import extract, jobs, knowledge, report, vectors
from assayflow.sources import codes, files, shared, versions
from assayflow.streaming import limits, stateful

NOW = "2024-01-31 00:00:00"


def at(s):
    return dt.datetime.fromisoformat(s)


def test_triage(spark):
    rows = [
        ("a/report.PDF", "application/pdf", 10, b"%PDF-1.4"),
        ("a/report.csv", "text/csv", 10, b"%PDF"),
        ("a/x.pdf", "text/csv", 10, b"%PDF"),
        ("a/x.png", "image/png", 11, b"\x89PNG"),
        ("a/x.jpg", "image/jpeg", 10, b"%PDF"),
        ("a/x.png", "image/png", 10, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, path string, mime string, length long, content binary")
    got = [(r["ok"], r["http_code"], r["reason"]) for r in files.triage_uploads(df, 10).orderBy("i").collect()]
    assert got == [(True, 202, None), (False, 400, "extension"), (False, 400, "mime"), (False, 413, "size"), (False, 400, "content"), (False, 400, "content")]


def test_pages(spark):
    rows = [(1, 2, "native", " b "), (1, 1, "native", "a"), (1, 3, "ocr", "no"), (2, 1, "native", " \n"), (2, 1, "ocr", "yes"), (3, 1, "native", None)]
    got = {r["doc_id"]: r["text"] for r in files.assemble_document_text(spark.createDataFrame(rows, "doc_id long, page_no int, method string, text string")).collect()}
    assert got == {1: "a\n b", 2: "yes", 3: ""}


def test_lifecycle(spark):
    rows = [("a", "completed", "2024-01-01 00:00:00", "2024-01-02 00:00:00", "f"), ("b", "expired", "2024-01-01 00:00:00", "2024-01-16 23:59:59", ""), ("c", "expired", "2024-01-01 00:00:00", "2024-01-17 00:00:00", None), ("d", "failed", "2024-01-24 00:00:00", "2024-01-24 00:00:00", "g")]
    df = spark.createDataFrame([(i, s, at(c), at(u), f) for i, s, c, u, f in rows], "id string, status string, created_at timestamp, updated_at timestamp, file_path string")
    assert {r["id"]: r["status"] for r in jobs.mark_expired(df, NOW).collect()} == {"a": "expired", "b": "expired", "c": "expired", "d": "failed"}
    assert [r["id"] for r in jobs.files_to_delete(df, NOW).collect()] == ["a"]
    left, _ = jobs.purge_expired(jobs.mark_expired(df, NOW), df.select(F.col("id").alias("job_id")), NOW)
    assert sorted(r["id"] for r in left.collect()) == ["a", "c", "d"]
    assert tuple(jobs.cleanup_summary(df, NOW).first()) == (1, 1, 1)


def test_severity(spark):
    rows = [(10.0, 10.0, 20.0), (8.5, 10.0, 20.0), (8.4, 10.0, 20.0), (7.0, 10.0, 20.0), (5.0, 10.0, 20.0), (4.9, 10.0, 20.0), (-1.0, 0.0, 5.0), (1.0, None, 5.0), (None, 1.0, 2.0), (30.1, 10.0, 20.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, value double, normal_min double, normal_max double")
    got = [r["severity"] for r in report.classify_severity(df).orderBy("i").collect()]
    assert got == ["unknown", "mild", "moderate", "moderate", "severe", "critical", "mild", "unknown", "unknown", "critical"]


def test_topk_blocks_and_zero(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(99, [0.0, 0.0, 0.0])]
    k = spark.createDataFrame(rows, "id long, vec array<double>")
    got = vectors.vector_topk(k.where("id < 2").select(F.col("id").alias("query_id"), "vec"), k, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(0, 0), (0, 35), (0, 30), (1, 1), (1, 36), (1, 37)] or got[0]["dist"] < 1e-12
    zero = vectors.vector_topk(k.where("id = 99").select(F.col("id").alias("query_id"), "vec"), k, 2)
    assert vectors.within_distance(zero).count() == 0


REQUESTS = [(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:00:59"), (3, 7, "2024-01-01 00:01:00"), (4, 7, "2024-01-01 00:01:10"), (5, 7, "2024-01-01 00:01:20"), (6, 8, "2024-01-01 00:00:30"), (7, 7, "2024-01-01 00:02:00")]


def write_batches(spark, tmp_path, batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    return spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_rate_limit(spark):
    rows = [(i, k, at(t)) for i, k, t in REQUESTS]
    schema = "event_id long, key long, ts timestamp"
    batch = {(r["event_id"], r["n"], r["allowed"]) for r in limits.rate_limit(spark.createDataFrame(rows, schema), 2, 60).collect()}
    assert batch == {(1, 1, True), (2, 2, True), (3, 1, True), (4, 2, True), (5, 3, False), (6, 1, True), (7, 1, True)}


def test_rate_limit_over_pauses(spark):
    """Against a walk over each client's requests, with pauses shorter, equal and longer than a window."""
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(600):
        t += rng.choice((0, 1, 5, 30, 59, 60, 61, 300)) * 1_000_000
        rows.append((i, rng.randrange(3), dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=t)))
    rows += [(9000, None, rows[0][2]), (9001, 1, None)]
    want, opened = {}, {}
    for i, key, ts in rows[:600]:
        start, n = opened.get(key, (None, 0))
        start, n = (ts, 1) if start is None or ts >= start + dt.timedelta(seconds=60) else (start, n + 1)
        opened[key] = (start, n)
        want[i] = (start, n, n <= 2)
    got = limits.rate_limit(spark.createDataFrame(rows, "event_id long, key long, ts timestamp"), 2, 60).collect()
    assert {r["event_id"]: (r["window_start"], r["n"], r["allowed"]) for r in got} == want


def test_stuck_alerts_out_of_order(spark, tmp_path):
    """An older event that comes late neither arms nor clears anything; a newer one does both."""
    e = [
        [(1, "00:10:00", "completed"), (2, "00:10:00", "processing"), (3, "00:10:00", "processing")],
        [(1, "00:05:00", "processing"), (2, "00:05:00", "completed"), (3, "00:12:00", "completed")],
        [(4, "03:00:00", "queued")],
        [(4, "04:00:00", "queued")],
    ]
    batches = [[(j, at(f"2024-01-01 {t}"), s) for j, t, s in b] for b in e]
    schema = "job_id long, ts timestamp, status string"
    path = stateful.run_to_table(stateful.stuck_alerts_stream(write_batches(spark, tmp_path, batches, schema), 600, "30 minutes"), "late-test")
    batch = stateful.stuck_alerts(spark.createDataFrame([r for b in batches for r in b], schema), "2024-01-01 03:30:00", 600)
    assert {tuple(r) for r in spark.read.parquet(path).select("job_id", "stuck_since").collect()} == {tuple(r) for r in batch.collect()} == {(2, at("2024-01-01 00:10:00"))}


def test_results_of_a_repeated_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "job_id long, text string")
    doc = F.struct(F.col("text").alias("overall_summary"), F.lit(0.5).alias("confidence_score"))
    rows = rows.select("job_id", doc.alias("doc"), F.lit(3).alias("processing_time"), F.lit("p").alias("llm_provider"), F.lit("m").alias("model"))
    for batch, ids in ((0, (1,)), (1, (2,)), (0, (1,))):
        files.store_results(rows.where(F.col("job_id").isin(*ids)), str(tmp_path / "results"), NOW, batch)
    assert sorted(r["job_id"] for r in versions.read_batches(spark, str(tmp_path / "results")).collect()) == [1, 2]


def test_code_lists_of_several_files(spark, tmp_path):
    for name, text in (("b.csv", 'A,B\n1,"x\ny"\n2,\n'), ("a.csv", "A,B\n3,z\n")):
        (tmp_path / name).write_text(text)
    got = [(r["row_no"], r["A"], r["B"]) for r in codes.read_lab_codes(spark, str(tmp_path)).orderBy("row_no").collect()]
    assert got == [(0, "3", "z"), (1, "1", "x\ny"), (2, "2", "")]


def test_batches_of_nulls_and_ties(spark):
    rows = [(None, "n")] * 3 + [(5, "b"), (5, "a"), (5, "c"), (200_001, "z")]
    df = spark.createDataFrame([(o, x, i) for i, (o, x) in enumerate(rows)], "ord long, content string, i long")
    got = [[(r["i"], r["batch"]) for r in knowledge.assign_batches(df.repartition(n, "i"), size=2).orderBy("i").collect()] for n in (1, 3)]
    assert got[0] == got[1] and sorted(b for _, b in got[0]) == [0, 0, 1, 1, 2, 2, 3]
    assert {b for i, b in got[0] if i < 3} == {0, 1} and got[0][6] == (6, 3)


def test_batches_of_a_sparse_order(spark):
    """Order values far apart, all equal, or nearly so: the same numbers, and no window but over the ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for step in (0, 1, 10**9):
            rows = [(i * step, i) for i in range(1000)]
            df = spark.createDataFrame(rows, "ord long, i long").repartition(5)
            got = {r["i"]: r["batch"] for r in knowledge.assign_batches(df, size=64).collect()}
            assert sorted(got.values()) == [i // 64 for i in range(1000)] and (step == 0 or got == {i: i // 64 for i in range(1000)})
            numbers = shared.numbered(df, "ord", "i")
            assert {r["i"]: r["no"] for r in numbers.collect()} == {i: i for i in range(1000)}
            placed = numbers._jdf.queryExecution().optimizedPlan().toString()
            assert placed.count("Window") == 1 and "Window [sum(__n" in placed
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert shared.numbered(df.limit(0), "ord").count() == 0


def test_scratch_tables_go(spark):
    """What a step wrote goes at its end, but what it says shall stay, and what was there before; an error leaves all."""
    rows = spark.range(3)
    before = shared.stored(rows, "before")
    with shared.scratch() as stays:
        gone = shared.stored(rows, "gone")
        with shared.scratch() as inner:
            kept = shared.stored(rows, "kept")
            inner.append(shared._made[-1])
        stays += inner
        shared.shared_path(spark, "never-written")
    assert before.count() == kept.count() == 3
    with pytest.raises(Exception, match="(?i)file"):
        gone.count()
    with pytest.raises(ZeroDivisionError), shared.scratch():
        left = shared.stored(rows, "left")
        1 / 0
    assert left.count() == 3


def test_shared_folder(monkeypatch):
    class Session:
        def __init__(self, master, folder=None):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = self
            self.master = master
            self.getConf = lambda: {}

    assert shared.shared_dir(Session("spark://host:7077", "s3://bucket/x/")) == "s3://bucket/x"
    assert shared.shared_dir(Session("local[4]")).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match=r"spark.checkpoint.dir"):
            shared.shared_dir(Session(master))


def test_stuck_and_cached(spark, tmp_path):
    e = [(1, "2024-01-01 00:00:00", "processing"), (2, "2024-01-01 00:00:00", "processing"), (1, "2024-01-01 00:05:00", "completed"), (3, "2024-01-01 02:00:00", "queued"), (3, "2024-01-01 03:00:00", "queued")]
    rows = [(j, at(t), s) for j, t, s in e]
    schema = "job_id long, ts timestamp, status string"
    stream = write_batches(spark, tmp_path, [rows[:3], rows[3:4], rows[4:]], schema)
    path = stateful.run_to_table(stateful.stuck_alerts_stream(stream, 600), "stuck-test")
    batch = {tuple(r) for r in stateful.stuck_alerts(spark.createDataFrame(rows, schema), "2024-01-01 03:00:00", 600).collect()}
    assert {tuple(r) for r in spark.read.parquet(path).select("job_id", "stuck_since").collect()} == batch == {(2, at("2024-01-01 00:00:00"))}
    c = spark.createDataFrame([(1, "old", at("2024-01-01 00:00:00"), 3600), (1, "new", at("2024-01-01 00:10:00"), 3600), (2, "gone", at("2024-01-01 00:00:00"), 60)], "job_id long, doc string, written_at timestamp, ttl_sec int")
    assert [(r["job_id"], r["doc"]) for r in stateful.latest_cached(c, "2024-01-01 00:30:00").collect()] == [(1, "new")]


def test_latest_cached_stream(spark, tmp_path):
    c = [(1, "old", "2024-01-01 00:00:00", 3600), (1, "new", "2024-01-01 00:10:00", 3600), (2, "short", "2024-01-01 00:00:00", 60), (1, "older", "2024-01-01 00:05:00", 3600), (3, "late", "2024-01-01 00:40:00", 3600), (3, "later", "2024-01-01 00:50:00", 3600)]
    # Lifetimes of their own: 4's newer row ends before its older one would; 5's newer one, which comes first, outlasts it.
    c += [(4, "long", "2024-01-01 00:00:00", 9999), (4, "brief", "2024-01-01 00:12:00", 60), (5, "lasts", "2024-01-01 00:12:00", 9999), (5, "before", "2024-01-01 00:11:00", 60)]
    rows = [(j, d, at(t), ttl) for j, d, t, ttl in c]
    schema = "job_id long, doc string, written_at timestamp, ttl_sec int"
    rows = rows[:1] + rows[6:7] + rows[1:3] + rows[7:9] + rows[3:5] + rows[9:] + rows[5:6]
    stream = write_batches(spark, tmp_path, [rows[:2], rows[2:6], rows[6:9], rows[9:]], schema)
    path = stateful.run_to_table(stateful.latest_cached_stream(stream, "10 minutes"), "cached-test")
    out = spark.read.parquet(path).collect()
    live = {}
    for r in sorted(out, key=lambda r: (r["written_at"], not r["live"])):
        live[r["job_id"]] = r["doc"] if r["live"] else None
    assert live == {1: "new", 2: None, 3: "later", 4: None, 5: "lasts"}
    batch = stateful.latest_cached(spark.createDataFrame(rows, schema), "2024-01-01 00:50:00")
    assert {r["job_id"]: r["doc"] for r in batch.collect()} == {1: "new", 3: "later", 4: "long", 5: "lasts"}


def test_job_state_stream(spark, tmp_path):
    e = [(1, "2024-01-01 00:00:00", "processing", "parsing", None), (2, "2024-01-01 00:00:00", "queued", "uploading", "x"), (1, "2024-01-01 00:05:00", "completed", "done", None), (2, "2024-01-01 00:06:00", "failed", "failed", None)]
    rows = [(j, at(t), s, g, x) for j, t, s, g, x in e]
    schema = "job_id long, ts timestamp, status string, stage string, error string"
    stream = write_batches(spark, tmp_path, [rows[:2], rows[2:]], schema)
    path = stateful.run_to_table(stateful.job_state(stream), "state-test", "update")
    last = {}
    for r in sorted(spark.read.parquet(path).collect(), key=lambda r: r["updated_at"]):
        last[r["job_id"]] = (r["status"], r["progress"], r["error"])
    assert last == {1: ("completed", 100, None), 2: ("failed", 100, "x")}
    assert {r["job_id"]: (r["status"], r["progress"], r["error"]) for r in stateful.job_state(spark.createDataFrame(rows, schema)).collect()} == last


def test_once(spark):
    rows = spark.createDataFrame([(1, at("2024-01-01 00:00:01")), (1, at("2024-01-01 00:00:00")), (2, at("2024-01-01 00:00:00"))], "job_id long, ts timestamp")
    assert sorted((r["job_id"], r["ts"].second) for r in stateful.process_once(rows, "ts").collect()) == [(1, 0), (2, 0)]


def test_a_stream_stores_a_match_once(spark, tmp_path):
    """A match is one row, however many tests have its alias; read back it has all of them, each batch those that it was searched for, and a batch that is tried again its last rows."""
    schema = "id string, ord long, display_name string, aliases array<string>, unit string"
    first = spark.createDataFrame([(f"t{i}", i, f"test {i}", ["shared"], "mg/dl") for i in range(9)], schema)
    second = spark.createDataFrame([("u", 0, "shared", None, "")], schema)
    meds = spark.createDataFrame([("aspirin", 0, "Aspirin", "x", ["brand"])], "id string, ord long, display_name string, category string, aliases array<string>")
    units = spark.createDataFrame([("mg/dl", "mg/dL")], "variant string, canonical string")
    docs = [spark.createDataFrame([(k, text)], "doc_id long, text string") for k, text in enumerate(("shared 5 brand", "test 3: 6 mg/dl", "shared: 7 aspirin"))]
    path = str(tmp_path / "out")
    write = stateful.stream_extract(first, meds, units, path)
    for batch, k in ((docs[0].unionByName(docs[1]), 0), (docs[2], 1), (docs[0].unionByName(docs[1]), 0)):
        write(batch, k)
    stateful.stream_extract(second, meds, units, path)(docs[2], 2)
    assert versions.read_batches(spark, f"{path}/matches").count() == 4
    want = extract.extract_measurements(docs[0].unionByName(docs[1]).unionByName(docs[2]), first, units).unionByName(extract.extract_measurements(docs[2], second, units))
    assert sorted(stateful.read_measurements(spark, path).collect()) == sorted(want.collect()) and want.count() == 9 + 1 + 9 + 1
    assert sorted((r["doc_id"], r["id"]) for r in stateful.read_entities(spark, path).collect()) == [(0, "aspirin"), (2, "aspirin"), (2, "aspirin")]
