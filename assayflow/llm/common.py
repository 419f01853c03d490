"""Helpers shared by the training-data operators: shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.sources.shared import shared_path

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """df with a broadcast hint if it is counted to hold at most max_rows; otherwise df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


_kept: list = []


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gives, for all tasks of a Python worker that ask for this key. A worker keeps one thing, the last that it was asked for."""
    if not _kept or _kept[0] != key:
        _kept.clear()
        _kept.extend((key, make()))
    return _kept[1]


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """At most so many rows of texts at a time between Spark and a Python worker, whose memory they are a part of; a session that has less keeps it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def words_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

