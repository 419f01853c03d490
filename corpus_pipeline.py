"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing and tokens, one stage after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayflow.llm import bpe, jaccard_join, language_id, line_dedup, mixing
from assayflow.llm.common import bounded_batches, read_table, small, stored
from assayflow.sources.shared import scratch, shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least certainty of a document's words, each in its own language: below it, no language fits.
MIN_CERTAINTY = 0.4


def prepared(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents, in batches for Python of a bounded size."""
    bounded_batches(spark)
    return docs.select(*COLUMNS)


def with_lengths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null, no letters, or words less certain than MIN_CERTAINTY. A null lang is filled.

    A document of several languages stays if its words are certain. If nothing can be learned, as when all of
    lang is null, every document with letters stays, and a null lang is `und`.
    """
    docs = prepared(spark, docs)
    model = language_id.train(docs)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("certainty") >= MIN_CERTAINTY)
    kept = language_id.detect(docs, model).where(known if model.labels else F.col("text").rlike(r"\p{L}"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a source hold go; every document stays, with its new length."""
    return with_lengths(line_dedup.dedup_lines(prepared(spark, docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest id; rows without id stay.

    Rows that repeat an id are one document: the one of least hash of its text stays.
    """
    docs = prepared(spark, docs)
    classes = jaccard_join.near_duplicate_classes(docs)
    kept = stored(classes.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "pipeline-kept")
    single, several = (small(kept.where(c).select("doc_id"), 500_000) for c in (F.col("n") == 1, F.col("n") > 1))
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", "source", "lang")
    repeated = docs.join(several, "doc_id", "left_semi").withColumn("n", F.row_number().over(first)).where(F.col("n") == 1).select(*COLUMNS)
    return docs.join(single, "doc_id", "left_semi").unionByName(repeated).unionByName(docs.where(F.col("doc_id").isNull())).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, or up to three times as repeated rows."""
    docs = prepared(spark, docs)
    plan = mixing.thresholds(stored(mixing.sized(docs), "pipeline-sizes"))
    mixed = mixing.apply_mix(docs.withColumn("h", mixing.row_hash("doc_id", "text")), plan)
    return mixed.where(F.col("times") > 0).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digest of what the ids decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(prepared(spark, docs).select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN).drop("text")
    decoded = bpe.decode(encoded, path)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mix_sources", mix), ("bpe_tokens", tokens)]

#: A trained model and a similarity join decide which rows stay: not to be said in SQL. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again. What a stage wrote besides goes when it is done."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
