"""Line dedup by site-relative frequency, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.llm.common import small, stored

#: Production parameters: a line is boilerplate on more than this share of its site's pages, and on this many at least.
MAX_RATIO, MIN_PAGES = 0.05, 5


def page_lines(text: Column) -> Column:
    """The distinct non-blank lines of a page, each without spaces around it."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""))


def boilerplate_lines(pages: DataFrame, host: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, line, pages): the lines that more than max_ratio of the host's pages hold.

    Lines are counted by a 64-bit key first, with partial sums before the shuffle, so that only 24 bytes
    a distinct line move; the few keys above the threshold are then counted again by the line itself, so
    that no collision of keys can make a line boilerplate.
    """
    totals = stored(pages.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("total")), "line-totals")
    lines = pages.select(F.col(host).alias("host"), F.explode(page_lines(F.col(text))).alias("line")).withColumn("key", F.xxhash64("line"))
    frequent = (F.col("pages") >= min_pages) & (F.col("pages") > max_ratio * F.col("total"))

    def of_hosts(counts: DataFrame, columns: list[str]) -> DataFrame:
        t = small(totals.select(F.col("host").alias("t_host"), "total"))
        return counts.join(t, F.col("host").eqNullSafe(F.col("t_host"))).where(frequent).select("host", *columns)

    keys = stored(of_hosts(lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")), ["key"]), "line-keys")
    k = small(keys.select(F.col("host").alias("k_host"), F.col("key").alias("k_key")))
    same = lines.join(k, F.col("host").eqNullSafe(F.col("k_host")) & (F.col("key") == F.col("k_key")), "left_semi")
    return of_hosts(same.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")), ["line", "pages"])


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Drop from every page the lines that more than max_ratio of its host's pages hold.

    Adds n_lines and n_dropped and replaces text. Each row is a page, repeated rows too. A null host is a
    host of its own. A null text stays null with 0 lines; blank lines are counted but never dropped; all
    other columns pass through. Lines are compared without spaces around them; kept lines keep theirs.
    The boilerplate of one host holds at most (lines a page) / max_ratio lines, so it fits a row; the table
    of all hosts is broadcast only if it is counted to be small; else, as a stored table, it is joined in parts where a host is large.
    """
    found = stored(boilerplate_lines(pages, host, text, max_ratio, min_pages), "boilerplate")
    by_host = stored(found.groupBy(F.col("host").alias("__host")).agg(F.collect_set("line").alias("__boilerplate")), "boilerplate-hosts")
    joined = pages.join(small(by_host), pages[host].eqNullSafe(F.col("__host")), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__boilerplate"), F.trim(x)))
    joined = joined.withColumn("__kept", F.when(F.col("__boilerplate").isNull(), lines).otherwise(kept))
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n_kept = F.coalesce(F.size("__kept"), F.lit(0)).cast("long")
    out = {
        "n_lines": F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n_lines),
        "n_dropped": F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n_lines - n_kept),
        text: F.when(F.col(text).isNotNull(), F.array_join("__kept", "\n")),
    }
    return joined.withColumns(out).drop("__host", "__boilerplate", "__kept")


ORACLE = f"""
WITH pg AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
occ AS (SELECT source, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x)), lambda x: x <> ''))) AS line FROM pg),
tot AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
boiler AS (SELECT o.source, o.line FROM (SELECT source, line, count(*) AS pages FROM occ GROUP BY source, line) o
  JOIN tot t ON o.source IS NOT DISTINCT FROM t.source WHERE pages >= {MIN_PAGES} AND pages > {MAX_RATIO} * total),
per AS (SELECT source, list(line) AS b FROM boiler GROUP BY source),
j AS (SELECT pg.*, list_filter(ls, lambda x: NOT list_contains(coalesce(per.b, []), trim(x))) AS kept
  FROM pg LEFT JOIN per ON pg.source IS NOT DISTINCT FROM per.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len(kept) END AS n_dropped,
  CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text FROM j
"""
