"""Requests to a language model and its responses, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.operators.sanitize import kind, sanitize_column

#: The keys that a response must have, and the limits of a request.
REQUIRED = ["disclaimer", "input_summary", "abnormal_values", "normal_values", "medicines", "overall_summary", "questions_to_ask_doctor", "next_steps", "confidence_score"]
RAW_CHARS, LONG_TEXT = 8000, 500
HEAVY_TOKENS, LIGHT_TOKENS = 4096, 2048
#: Fixed value: a fenced block of a response.
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)```"


def repair_json(responses: DataFrame, text: str = "text") -> DataFrame:
    """Adds doc (a variant), repair_stage (whole, fence, braces) and error (truncated, invalid).

    The first of three that parses: the stripped text, its first fenced block, its first `{` to last `}`.
    """
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    fence = F.regexp_extract(t, FENCE, 1)
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    tries = {"whole": F.try_parse_json(t), "fence": F.try_parse_json(F.nullif(F.trim(fence), F.lit(""))), "braces": F.try_parse_json(F.nullif(braces, F.lit("")))}
    stage = F.lit(None).cast("string")
    for name, v in reversed(tries.items()):
        stage = F.when(v.isNotNull(), name).otherwise(stage)
    error = F.when(F.endswith(t, F.lit("}")), "invalid").otherwise("truncated")
    return responses.withColumns({"doc": F.coalesce(*tries.values()), "repair_stage": stage, "error": F.when(stage.isNull(), error)})


def missing_key(doc: Column) -> Column:
    """The first required key that a document lacks."""
    keys = F.filter(F.array(*[F.lit(k) for k in REQUIRED]), lambda k: ~F.array_contains(F.coalesce(F.json_object_keys(F.to_json(doc)), F.array().cast("array<string>")), k))
    return F.try_element_at(keys, F.lit(1))


def require_keys(responses: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds schema_error: the first missing key, or a confidence that is no number; null if all is there."""
    missing = missing_key(F.col(doc))
    number = kind(F.try_variant_get(doc, "$.confidence_score", "variant")).isin("int", "float", "boolean")
    return responses.withColumn("schema_error", F.when(missing.isNotNull(), F.concat(F.lit("missing key: "), missing)).when(~number, "confidence_score must be a number"))


def choose_model(parsed: DataFrame, tests: str = "tests", medicines: str = "medicines", text: str = "raw_text") -> DataFrame:
    """Adds model (heavy or light) and max_tokens: heavy with tests, over 500 characters, or with nothing found."""
    heavy = (F.size(tests) > 0) | (F.length(F.coalesce(text, F.lit(""))) > LONG_TEXT) | (F.size(medicines) <= 0)
    return parsed.withColumn("model", F.when(heavy, "heavy").otherwise("light")).withColumn("max_tokens", F.when(heavy, HEAVY_TOKENS).otherwise(LIGHT_TOKENS))


def build_requests(parsed: DataFrame, context: DataFrame | None, system: str, instructions: str, context_title: str = "Relevant medical knowledge:") -> DataFrame:
    """doc_id, payload and messages of parsed(doc_id, raw_text, tests, medicines).

    The payload is JSON with the text cut to 8000 characters; context(doc_id, ord, content) is put between
    fences, only where there is any. The wording is the caller's.
    """
    text = F.when(F.length("raw_text") > RAW_CHARS, F.concat(F.substring("raw_text", 1, RAW_CHARS), F.lit("…"))).otherwise(F.col("raw_text"))
    payload = F.to_json(F.struct(F.struct("tests", "medicines", text.alias("raw_text")).alias("parsed_data")))
    rows = parsed.select("doc_id", payload.alias("payload"))
    if context is not None:
        chunks = context.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda c: c["content"]), "\n---\n").alias("chunks"))
        rows = rows.join(chunks, "doc_id", "left")
    else:
        rows = rows.withColumn("chunks", F.lit(None).cast("string"))
    block = F.coalesce(F.concat(F.lit(f"\n\n{context_title}\n```\n"), F.col("chunks"), F.lit("\n```\n")), F.lit(""))
    user = F.concat(F.col("payload"), F.lit("\n"), block, F.lit("\n" + instructions))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select("doc_id", "payload", F.array(message("system", F.lit(system)), message("user", user)).alias("messages"))


def finalize_results(responses: DataFrame, reports: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, status, source (model or rules), doc of jobs(job_id): the response if it is repaired, clean and complete, else the rule-based report.

    responses(job_id, text), reports(job_id, report as a struct).
    """
    fixed = require_keys(repair_json(responses))
    fixed = fixed.withColumn("__doc", sanitize_column(F.col("doc"))).where(F.col("error").isNull()).select("job_id", F.col("__doc").alias("__response"))
    rules = reports.select("job_id", sanitize_column(F.parse_json(F.to_json("report"))).alias("__rules"))
    both = jobs.select("job_id").join(fixed, "job_id", "left").join(rules, "job_id", "left")
    used = F.col("__response").isNotNull()
    return both.select("job_id", F.lit("completed").alias("status"), F.when(used, "model").otherwise("rules").alias("source"), F.coalesce("__response", "__rules").alias("doc"))
