"""The life of processing jobs, as set-based updates with `now` as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Progress by stage.
PROGRESS = {"uploading": 5, "extracting_text": 25, "parsing": 45, "generating_explanation": 70, "finalizing": 90, "done": 100, "failed": 100}
EXPIRY_DAYS, STUCK_MINUTES, ORPHAN_SECONDS = 7, 10, 60


def before(column: str, now: str, interval: str) -> Column:
    """Strictly earlier than now less the interval."""
    return F.col(column) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {interval}")


def mark_expired(jobs: DataFrame, now: str, days: int = EXPIRY_DAYS) -> DataFrame:
    """Completed and failed jobs older than `days` become expired, as of now."""
    old = before("created_at", now, f"{days} DAYS") & F.col("status").isin("completed", "failed")
    return jobs.withColumns({"status": F.when(old, "expired").otherwise(F.col("status")), "updated_at": F.when(old, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))})


def files_to_delete(jobs: DataFrame, now: str, days: int = EXPIRY_DAYS) -> DataFrame:
    """id, file_path of old jobs of any status that have a file."""
    return jobs.where(before("created_at", now, f"{days} DAYS") & (F.coalesce("file_path", F.lit("")) != "")).select("id", "file_path")


def purgeable(now: str, days: int = EXPIRY_DAYS) -> Column:
    return (F.col("status") == "expired") & before("updated_at", now, f"{2 * days} DAYS")


def purge_expired(jobs: DataFrame, results: DataFrame, now: str, days: int = EXPIRY_DAYS) -> tuple[DataFrame, DataFrame]:
    """(jobs, results) without jobs that expired over 2 * days ago, and without their results."""
    gone = jobs.where(purgeable(now, days)).select(F.col("id").alias("job_id"))
    return jobs.where(~F.coalesce(purgeable(now, days), F.lit(False))), results.join(gone, "job_id", "left_anti")


def cleanup_summary(jobs: DataFrame, now: str, days: int = EXPIRY_DAYS) -> DataFrame:
    """expired_jobs, deleted_files, purged_jobs of one pass: expire, then delete, then purge."""
    old = before("created_at", now, f"{days} DAYS")
    return jobs.agg(
        F.count_if(old & F.col("status").isin("completed", "failed")).alias("expired_jobs"),
        F.count_if(old & (F.coalesce("file_path", F.lit("")) != "")).alias("deleted_files"),
        F.count_if(purgeable(now, days)).alias("purged_jobs"),  # those expired now have updated_at = now
    )


def stuck(now: str, minutes: int = STUCK_MINUTES) -> Column:
    return F.coalesce((F.col("status") == "processing") & before("updated_at", now, f"{minutes} MINUTES"), F.lit(False))


def recover_stuck(jobs: DataFrame, now: str, minutes: int = STUCK_MINUTES) -> DataFrame:
    """Jobs too long in processing are queued again; recovered says which."""
    was = jobs.withColumn("recovered", stuck(now, minutes))
    new = {"status": F.lit("queued"), "stage": F.lit("uploading"), "progress": F.lit(0), "error_message": F.lit(None).cast("string"), "updated_at": F.lit(now).cast("timestamp")}
    return was.withColumns({c: F.when(F.col("recovered"), v).otherwise(F.col(c)) for c, v in new.items() if c in jobs.columns})


def find_orphans(jobs: DataFrame, now: str, seconds: int = ORPHAN_SECONDS) -> DataFrame:
    """Ids of jobs that wait in the table longer than `seconds`."""
    return jobs.where((F.col("status") == "queued") & before("updated_at", now, f"{seconds} SECONDS")).select("id")


def advance_stage(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs after events(id, ts, status, stage, error): the last event's status, stage, progress and time; an error stays until another comes.

    Partial maxima come before the shuffle, so a job with very many events is no hot spot.
    """
    last = events.groupBy("id").agg(F.max_by(F.struct("status", "stage"), "ts").alias("__last"), F.max("ts").alias("__ts"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("ts"))).alias("__error"))
    progress = F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])
    j = jobs.join(last, "id", "left")
    stage = F.coalesce("__last.stage", "stage")
    return j.withColumns(
        {
            "status": F.coalesce("__last.status", "status"),
            "progress": F.when(F.col("__last").isNotNull(), F.coalesce(F.try_element_at(progress, F.col("__last.stage")), "progress")).otherwise(F.col("progress")),
            "stage": stage,
            "error_message": F.coalesce("__error", "error_message"),
            "updated_at": F.coalesce("__ts", "updated_at"),
        }
    ).drop("__last", "__ts", "__error")


def job_status(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests(request_id, job_id) with http_code 404, 410 or 200, and for 200 status, progress, stage, updated_at."""
    j = requests.join(jobs.select(F.col("id").alias("__id"), F.col("status").alias("__status"), "progress", "stage", "updated_at"), F.col("job_id") == F.col("__id"), "left")
    code = F.when(F.col("__id").isNull(), 404).when(F.col("__status") == "expired", 410).otherwise(200)
    shown = {c: F.when(F.col("http_code") == 200, F.col(s)) for c, s in (("status", "__status"), ("progress", "progress"), ("stage", "stage"), ("updated_at", "updated_at"))}
    return j.withColumn("http_code", code).select("request_id", "job_id", "http_code", *[v.alias(k) for k, v in shown.items()])


def serve_results(requests: DataFrame, jobs: DataFrame, cache: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """request_id, job_id, http_code, message, served_from, doc for every one of requests(request_id, job_id).

    missing 404, expired 410, failed 400, not completed 202, then a cached document inside its lifetime, then
    the first stored one, else 500. cache(job_id, doc, written_at, ttl_sec), results(id, job_id, result_json).
    """
    fresh = cache.where(F.timestamp_add("SECOND", F.col("ttl_sec"), F.col("written_at")) > F.lit(now).cast("timestamp")).groupBy("job_id").agg(F.max_by("doc", "written_at").alias("__cached"))
    stored = results.groupBy("job_id").agg(F.min_by("result_json", "id").alias("__stored"))
    j = requests.join(jobs.select(F.col("id").alias("__id"), "status", "error_message"), F.col("job_id") == F.col("__id"), "left").join(fresh, "job_id", "left").join(stored, "job_id", "left")
    doc = F.coalesce("__cached", "__stored")
    code = F.when(F.col("__id").isNull(), 404).when(F.col("status") == "expired", 410).when(F.col("status") == "failed", 400).when(F.col("status") != "completed", 202).when(doc.isNotNull(), 200).otherwise(500)
    message = (
        F.when(F.col("http_code") == 404, "Job not found").when(F.col("http_code") == 410, "This job has expired and is no longer available")
        .when(F.col("http_code") == 400, F.concat(F.lit("Job processing failed: "), F.coalesce(F.nullif("error_message", F.lit("")), F.lit("Unknown error"))))
        .when(F.col("http_code") == 202, F.concat(F.lit("Job not completed yet (current status: "), F.col("status"), F.lit(")"))).when(F.col("http_code") == 500, "Result not found for completed job")
    )
    source = F.when(F.col("http_code") == 200, F.when(F.col("__cached").isNotNull(), "cache").otherwise("store"))
    return j.withColumn("http_code", code).select("request_id", "job_id", "http_code", message.alias("message"), source.alias("served_from"), F.when(F.col("http_code") == 200, doc).alias("doc"))
