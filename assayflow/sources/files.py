"""Uploads, pages, catalogs and code lists as DataFrames, and the sinks of catalogs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.sources.versions import commit_batch

#: Accepted extensions with the bytes that such files start with, and declared types.
MAGIC = {".pdf": "25504446", ".jpg": "FFD8FF", ".jpeg": "FFD8FF", ".png": "89504E47"}
MIME = ("application/pdf", "image/jpeg", "image/png")
MAX_BYTES = 10 * 1024 * 1024
CATALOG_ENTRY = (
    "struct<display_name:string,loinc_code:string,category:string,unit:string,units:array<string>,aliases:array<string>,"
    "normal_min:string,normal_max:string,ranges:map<string,struct<min:string,max:string>>,meaning:string,normal_meaning:string,"
    "common_causes:array<string>,purpose:string,generic_name:string,mechanism:string,how_to_take:string,"
    "common_side_effects:array<string>,serious_side_effects:array<string>,drug_interactions:array<string>,"
    "precautions:array<string>,generic_alternative:string,lifestyle_tips:array<string>>"
)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows; the first bytes decide their kind, the rest is read only when asked for."""
    return spark.read.format("binaryFile").load(path)


def triage_uploads(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds ok, http_code and reason: the first failing check of extension, declared type, size and leading bytes.

    files(path, mime, length, content). A file of exactly max_bytes passes.
    """
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    starts = F.lit(False)
    for e, magic in MAGIC.items():
        starts = starts | ((ext == e) & F.startswith(F.hex(F.substring("content", 1, 4)), F.lit(magic)))
    reason = (
        F.when(~ext.isin(*MAGIC), "extension")
        .when(~F.coalesce(F.col("mime").isin(*MIME), F.lit(False)), "mime")
        .when(F.col("length") > max_bytes, "size")
        .when(~F.coalesce(starts, F.lit(False)), "content")
    )
    return files.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).withColumn("http_code", F.when(F.col("ok"), 202).when(F.col("reason") == "size", 413).otherwise(400))


def new_jobs(accepted: DataFrame, now: str) -> DataFrame:
    """A queued job for every accepted file(path, modificationTime). Ids are hashes, so that reruns agree."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    job = F.concat(F.lit("job_"), F.md5(F.concat_ws("|", "path", F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss"))))
    at = F.lit(now).cast("timestamp")
    return accepted.select(
        job.alias("id"), F.concat(F.lit("uploads/"), job, ext).alias("file_path"), F.lit("en-IN").alias("locale"), F.lit("auto").alias("context"), F.lit("queued").alias("status"),
        F.lit("uploading").alias("stage"), F.lit(5).alias("progress"), F.lit(None).cast("string").alias("error_message"), at.alias("created_at"), at.alias("updated_at"),
    )


def assemble_document_text(pages: DataFrame) -> DataFrame:
    """doc_id, text: native pages that are not blank, joined by line ends and trimmed; the OCR pages only if there is none.

    pages(doc_id, page_no, method, text). A document without any text has ''.
    """
    blank = F.coalesce(F.col("text").rlike(r"(?U)^\s*$"), F.lit(True))

    def joined(method: str) -> F.Column:
        own = F.when((F.col("method") == method) & ~blank, F.struct("page_no", "text"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda p: p["text"]), "\n")
        return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")

    both = pages.groupBy("doc_id").agg(joined("native").alias("native"), joined("ocr").alias("ocr"))
    return both.select("doc_id", F.coalesce(F.nullif("native", F.lit("")), "ocr").alias("text"))


def quarantine_empty_text(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with text, failures): a blank text fails its job."""
    blank = F.coalesce(F.col("text").rlike(r"(?U)^\s*$"), F.lit(True))
    failed = docs.where(blank).select("doc_id", F.lit("failed").alias("status"), F.lit("failed").alias("stage"), F.lit("OCR returned empty text").alias("error_message"))
    return docs.where(~blank), failed


def parse_catalog(texts: DataFrame, skip_metadata: bool = True) -> DataFrame:
    """id, ord, entry from JSON objects of objects in texts(value), in the order of the text.

    Entries that are not objects are left out, with skip_metadata also keys that start with `_`. Numbers keep
    their spelling.
    """
    entries = texts.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("ord", "e")).where(F.startswith("e.value", F.lit("{")))
    rows = entries.select(F.col("e.key").alias("id"), "ord", F.from_json("e.value", CATALOG_ENTRY).alias("entry")).where(F.col("entry").isNotNull())
    return rows.where(~F.startswith("id", F.lit("_"))) if skip_metadata else rows


def read_catalog(spark: SparkSession, path: str, skip_metadata: bool = True) -> DataFrame:
    """A catalog file as rows: a dictionary of bounded size, parsed as one text so that order is kept."""
    return parse_catalog(spark.read.text(path, wholetext=True), skip_metadata)


def write_catalog(df: DataFrame, path: str, key: str = "id", ordered_by: str | None = None) -> None:
    """A catalog as JSON lines, sorted by key, or in insertion order by another column."""
    df.orderBy(ordered_by or key).write.mode("overwrite").json(path)


def result_rows(results: DataFrame, now: str) -> DataFrame:
    """Rows to store: job_id, the document as JSON, confidence (0 if missing), time, provider, model, cached = false."""
    return results.select(
        "job_id", F.to_json("doc").alias("result_json"), F.coalesce(F.col("doc.confidence_score").cast("double"), F.lit(0.0)).alias("confidence"), "processing_time", "llm_provider", "model",
        F.lit(False).alias("cached"), F.lit(now).cast("timestamp").alias("created_at"),
    )


def store_results(results: DataFrame, path: str, now: str, batch: str | int) -> None:
    """Commit the result rows of a batch to the table at path, to be read with versions.read_batches().

    A batch that is tried again replaces its rows at once, and others stay: a reader never sees a part of either try.
    """
    commit_batch(result_rows(results, now), path, batch)
