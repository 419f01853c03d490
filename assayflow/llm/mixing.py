"""Mixing sources to target weights by hash thresholds found from histograms, without a sort of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.llm.common import small, stored, words_count

#: Production parameters: weights by order of source, repeated; repeats of a document at most; bits of a histogram level and levels.
WEIGHTS, MAX_REPEATS, BITS, LEVELS = (5, 2, 1), 3, 12, 3


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes(source, source_size) -> + target: shares of the total by weight, none above max_repeats times its source.

    Weights repeat over the sources in code point order, null last. The excess over a cap is shared again
    by weight until none is above: with the sources ordered by cap / weight, a prefix is capped and one
    rate serves the rest. Running sums give the rate for each length of that prefix; of those that keep the
    next source under its cap the largest is right, as capping more sources only lowers it. There is one row a
    source, and these rows are ordered in one task: sources are named corpora, thousands at most, and not hosts.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(max_repeats) * F.col("source_size")
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    rated = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("rate", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("rate", F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("rate")))
    )
    rate = F.max("rate").over(Window.partitionBy())
    return rated.withColumn("target", F.coalesce(F.least(rate * F.col("weight"), F.col("cap").cast("double")), F.lit(0.0))).select("source", "source_size", "target")


def row_hash(id_col: str, text: str) -> Column:
    """A hash of BITS * LEVELS bits of a row's id and text."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size in words and hash of every document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), words_count(F.col(text)).alias("size"), row_hash(id_col, text).alias("h"))


def thresholds(base: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """base(source, size, h) -> source, source_size, target, repeats, prefix: the plan of the mix, one row a source.

    A document is taken `repeats` times, and once more if its hash lies below `prefix`. That threshold comes
    from histograms of words by source and hash bucket: 4096 buckets of all documents, then 4096 of the
    boundary bucket alone, then again; the last cell is taken if that comes nearer. Thresholds are nested: a
    larger budget keeps all that a smaller one takes.
    """
    sizes = stored(base.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("long")
    state = source_targets(sizes, weights, max_repeats).withColumn("repeats", whole)
    # prefix: where the threshold stands so far; left: words still to take from there on.
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("left", F.col("target") - F.col("repeats") * F.col("source_size"))
    state = stored(state, "mix-state")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        s = small(state.select(F.col("source").alias("s"), "prefix", "left"))
        inside = F.shiftright("h", shift + BITS) == F.col("prefix")
        hist = base.join(s, F.col("source").eqNullSafe(F.col("s")) & inside).groupBy("source", F.shiftright("h", shift).alias("cell")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        run = Window.partitionBy("source").orderBy("cell")
        cum = hist.withColumn("upto", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
        takes = F.col("upto") <= F.col("left")
        if level == LEVELS:
            takes = takes | ((F.col("before") <= F.col("left")) & (F.col("words") <= 2 * (F.col("left") - F.col("before"))))
        # The first bucket that is not taken whole: all below it are.
        cut = cum.where(~takes).groupBy(F.col("source").alias("c")).agg(F.min(F.struct("cell", "before")).alias("cut"))
        joined = state.join(cut, F.col("source").eqNullSafe(F.col("c")), "left")
        beyond = F.shiftleft(F.col("prefix") + 1, BITS)
        left = F.when(F.col("cut").isNull(), F.lit(0.0)).otherwise(F.col("left") - F.col("cut.before"))
        state = stored(joined.select("source", "source_size", "target", "repeats", F.coalesce("cut.cell", beyond).alias("prefix"), left.alias("left")), "mix-state")
    return state.drop("left")


def apply_mix(rows: DataFrame, plan: DataFrame, source: str = "source", h: str = "h", max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds source_size, target and times, how often the mix takes each row."""
    p = small(plan.withColumnRenamed("source", "__source"))
    times = F.col("repeats") + F.when((F.col(h) < F.col("prefix")) & (F.col("repeats") < max_repeats), 1).otherwise(0)
    return rows.join(p, F.col(source).eqNullSafe(F.col("__source"))).withColumn("times", times).drop("__source", "repeats", "prefix")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target and taken: how many words the mix takes of each document.

    Reruns agree. Null texts have size 0; a null source is a source; rows equal in id and text are taken
    together. Input columns of other names play no part.
    """
    base = stored(sized(docs, id_col, source, text), "mix-sizes")
    mixed = apply_mix(base, thresholds(base, weights, max_repeats), max_repeats=max_repeats)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


ORACLE = r"""
WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 9))::BIGINT AS h FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM sizes),
r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
t AS (SELECT source, source_size, coalesce(least((SELECT max(rate) FROM r q WHERE q.rate * q.weight <= q.cap) * weight, cap::DOUBLE), 0) AS target FROM r),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS repeats FROM t),
cells AS (SELECT b.source, h, CAST(sum(size) AS BIGINT) AS words FROM base b GROUP BY b.source, h),
cum AS (SELECT c.*, u.target - u.repeats * u.source_size AS budget, CAST(sum(words) OVER (PARTITION BY c.source ORDER BY h) AS BIGINT) AS upto
  FROM cells c JOIN u ON c.source IS NOT DISTINCT FROM u.source),
cut AS (SELECT source, min(h) AS at FROM cum WHERE NOT (upto <= budget OR (upto - words <= budget AND words <= 2 * (budget - (upto - words)))) GROUP BY source)
SELECT b.doc_id, b.size, u.source_size, u.target,
  b.size * (u.repeats + CASE WHEN u.repeats < 3 AND (cut.at IS NULL OR b.h < cut.at) THEN 1 ELSE 0 END) AS taken
FROM base b JOIN u ON b.source IS NOT DISTINCT FROM u.source LEFT JOIN cut ON b.source IS NOT DISTINCT FROM cut.source
"""
