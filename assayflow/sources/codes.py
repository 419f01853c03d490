"""Code lists as CSV files whose cells may hold line ends, read in many tasks."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayflow.sources.shared import small, stored

#: A line, read from outside of quotes, that ends inside of them: whole cells, then one whose quote stays open. A quote within a cell that doesn't begin with one is a character.
_OPEN = r'^(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|(?!")[^,]*+),)*+"[^"]*+(?:""[^"]*+)*+$'


def _before(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds if_out and if_in: whether a row is reached inside of quotes, if the first row of its group is entered outside or inside.

    rows has from_out and from_in, where a row leads from either side. A row keeps the side, changes it, or leads to one whatever came before;
    so what counts is the last row of the third kind, and how many of the second came after it.
    """
    group = Window.partitionBy(*by).orderBy(order)
    earlier, upto = group.rowsBetween(Window.unboundedPreceding, -1), group.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__swaps", F.sum(F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0)).over(upto))
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").cast("int").alias("side"), F.col("__swaps").alias("swaps")))
    rows = rows.withColumn("__fixed", F.last(fixed, ignorenulls=True).over(earlier)).withColumn("__swaps", F.coalesce(F.lag("__swaps").over(group), F.lit(0)))
    side = lambda start: F.coalesce(F.col("__fixed.side") + F.col("__swaps") - F.col("__fixed.swaps"), start + F.col("__swaps")) % 2 == 1
    return rows.withColumns({"if_out": side(F.lit(0)), "if_in": side(F.lit(1))}).drop("__swaps", "__fixed")


def _after(c: str) -> Column:
    return F.when(F.col(c), F.col("from_in")).otherwise(F.col("from_out"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record, file_no and text: the records of CSV files, whole, numbered in the order of files and of records in a file.

    A file is read in ranges, as any text file, so a large one is many tasks. Whether a line begins a record depends on
    all quotes before it: each range says where it leads from outside and from inside of quotes, and how many records begin in it
    in either case. Prefix sums over the ranges, one row each, then say which case it is and what number its first record has. A record
    that goes over the end of a range gets the number it began with. Empty lines between records are no records.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumns({"from_out": F.col("value").rlike(_OPEN), "from_in": F.concat(F.lit('"'), "value").rlike(_OPEN)})
    lines = stored(_before(lines, ["file", "range"], "at").withColumn("filled", ~F.col("value").isin("", "\r")), "code-lines")
    begins = lambda c: F.col("filled") & ~F.col(c)
    ranges = lines.groupBy("file", "range").agg(
        F.max_by(_after("if_out"), "at").alias("from_out"), F.max_by(_after("if_in"), "at").alias("from_in"), F.count_if(begins("if_out")).alias("n_out"), F.count_if(begins("if_in")).alias("n_in")
    )
    ranges = _before(ranges, ["file"], "range").withColumn("n", F.when(F.col("if_out"), F.col("n_in")).otherwise(F.col("n_out")))
    earlier = Window.orderBy("file", "range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = ranges.select("file", "range", F.col("if_out").alias("inside"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.dense_rank().over(Window.orderBy("file")).alias("file_no"))
    whole = lines.join(small(ranges), ["file", "range"]).withColumn("within", F.when(F.col("inside"), F.col("if_in")).otherwise(F.col("if_out")))
    upto = Window.partitionBy("file", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    whole = whole.withColumn("record", F.col("base") + F.count_if(F.col("filled") & ~F.col("within")).over(upto)).where(F.col("filled") | F.col("within"))
    order = F.array_sort(F.collect_list(F.struct("range", "at", "value")))
    records = whole.groupBy("file_no", "record").agg(F.array_join(F.transform(order, lambda r: r["value"]), "\n").alias("text"))
    return records.select("record", "file_no", F.regexp_replace("text", "\r$", "").alias("text"))


def read_lab_codes(spark: SparkSession, path: str) -> DataFrame:
    """A code list with a header, all columns text, empty ones '', and row_no in the order of files and of rows in a file.

    Every file has the header of the first one. Quotes are as csv has them: around a cell, doubled inside it; other quotes are
    characters. A record with fewer cells has empty ones at its end.
    """
    records = stored(read_records(spark, path), "code-records")
    heads = records.groupBy("file_no").agg(F.min("record").alias("head"), F.min_by("text", "record").alias("text"))
    first = heads.orderBy("file_no").select("text").first()
    names = next(csv.reader([*first["text"].lstrip("\ufeff").splitlines(keepends=True)])) if first else []
    if not names:
        return spark.createDataFrame([], "row_no long")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = records.join(small(heads.select("file_no", "head")), "file_no").where(F.col("record") > F.col("head"))
    cells = F.from_csv("text", schema, {"quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"})
    rows = rows.select(cells.alias("c"), (F.col("record") - 1 - F.col("file_no")).alias("row_no"))
    return rows.select(*[F.coalesce(F.col("c")[n], F.lit("")).alias(n) for n in names], "row_no")
