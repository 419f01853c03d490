"""Importance resampling towards a target's hashed n-grams: documents drawn by weight and Gumbel noise."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayflow.llm.common import small, stored
from assayflow.llm.hashing import CRC_TABLE

#: Production parameters: words of a feature at most, buckets, seed of the noise, fewest words of a document that may be drawn, per cent drawn.
NGRAM, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Features above so many bytes, few of a length, get their CRC one by one; documents whose features are in memory at a time.
LONG, TEXTS = 64, 128
#: A-Z to a-z, and a blank for each byte that is no digit, no ASCII letter and no part of a character beyond ASCII.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def crcs(features: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32 of each of the features.

    Those of one length are the rows of a matrix of bytes; one step takes a column of it and updates all their
    CRCs. Each matrix' results are scattered back to its features' places.
    """
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    out = np.empty(len(features), np.uint32)
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = order[a:b]
        length = int(lengths[own[0]])
        if length > LONG:
            out[own] = [zlib.crc32(features[i]) for i in own.tolist()]
            continue
        matrix = np.frombuffer(b"".join([features[i] for i in own.tolist()]), np.uint8).reshape(-1, length)
        crc = np.full(len(own), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(matrix.T):
            crc = CRC_TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[own] = ~crc
    return out


def features_of(text: bytes, ngram: int) -> tuple[int, list[bytes]]:
    """Number of words of a text, and all runs of 1 to ngram of them."""
    words = text.translate(_WORDS).split()
    runs = [words] + [[b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] for k in range(2, ngram + 1)]
    return len(words), words if ngram == 1 else list(chain.from_iterable(runs))


def bucketed(texts: pa.Array, ngram: int, buckets: int) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """For some texts at a time: their numbers of words and of features, and the buckets of all their features in turn. Distinct features are hashed once."""
    for at in range(0, len(texts), TEXTS):
        each = [features_of(t or b"", ngram) for t in texts.slice(at, TEXTS).to_pylist()]
        distinct = list(set(chain.from_iterable(f for _, f in each)))
        bucket = dict(zip(distinct, (crcs(distinct) % buckets).tolist(), strict=True))
        lengths = [len(f) for _, f in each]
        yield [n for n, _ in each], lengths, np.fromiter(map(bucket.__getitem__, chain.from_iterable(f for _, f in each)), np.int64, sum(lengths))


def histogram(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket. A task gives one row a bucket at most, so no word, however frequent, moves more than once a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, own in bucketed(batch.column(0), ngram, buckets):
                n += np.bincount(own, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    rows = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: in thousandths, the log of how much more frequent a bucket is in the target than in docs, each count one up. One row a bucket, so `buckets` bounds it."""
    s, t = (histogram(x, ngram, buckets).withColumnRenamed("n", name) for x, name in ((docs, "s"), (target, "t")))
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    total = Window.partitionBy()  # `buckets` rows
    up = (F.col("t") + 1).cast("double") * (F.sum("s").over(total) + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.sum("t").over(total) + buckets).cast("double")
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).alias("gain"))


def weigh(docs: DataFrame, gains: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, id_col: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document. The gains, one a bucket, go to the workers as they are."""
    table = np.zeros(buckets, np.int64)
    for r in gains.collect():
        table[r["bucket"]] = r["gain"]

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weight(texts: pa.Array) -> pa.Array:
        out = []
        for words, lengths, own in bucketed(texts, ngram, buckets):
            n = np.array(lengths, np.int64)
            upto = np.concatenate([[0], np.cumsum(table[own])])
            end = np.cumsum(n)
            out.append((np.array(words, np.int64), n, (upto[end] - upto[end - n]) // np.maximum(n, 1)))
        columns = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["n_words", "n_features", "weight"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = docs.select(F.col(id_col).alias("doc_id"), weight(F.col(text).cast("binary")).alias("w")).select("doc_id", "w.*")
    return rows.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds rank to scored(doc_id, n_words, score, ...): 1, 2, 3... by score, ties to the smaller id, of the share drawn; null for the rest.

    scored is read several times and has to be a stored table. Counts of scores, of which there are some ten
    thousands whatever the table's size (they are thousandths of logs), say which score is the last that is
    drawn; only documents from there on are sorted, by ranges over many tasks, and their ranks come from places in
    a range and a prefix sum over ranges. Null ids come first among ties, then rows of fewer features.
    """
    spark = scored.sparkSession
    may = F.col("n_words") >= least_words
    counts = scored.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("score").desc())))  # one row a score
    k = counts.agg(F.floor(F.coalesce(F.sum("n"), F.lit(0)) * percent / 100).alias("k")).first()["k"]
    last = upto.where(F.col("upto") >= k).agg(F.max("score").alias("score")).first()["score"] if k else None
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = may & (F.col("score") >= last)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc()]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(scored.where(near).repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "resample-places")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", part).join(small(bases), "part").withColumn("rank", F.when(rank <= k, rank))
    return scored.where(~near).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null where it isn't drawn.

    A document's features are its runs of 1 to ngram words; its weight is the floored mean of their buckets' gains
    (none: 0), its score the weight plus Gumbel noise of seed and id. Of the documents of least_words or more,
    that per cent of highest scores is drawn. Features are counted over all texts of both tables. Null texts
    have no words; a null id hashes as nothing after the seed; repeated rows count and are drawn as rows of
    their own; other columns play no part. An empty table gives an empty one; an empty target gives gains all the same.
    """
    gains = bucket_gains(docs.select(F.col(text).alias("text")), target.select(F.col(text).alias("text")), ngram, buckets)
    return draw(stored(weigh(docs, gains, ngram, buckets, id_col, text, seed), "resample-scored"), least_words, percent)


ORACLE = r"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(0, 256) r(i))),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, ws FROM dw),
f AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
g AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
b AS (SELECT w, xor(list_reduce(list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM f UNION SELECT w FROM g), tab),
s AS (SELECT bucket, sum(n) AS s FROM f JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM g JOIN b USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT range AS bucket FROM range(0, 10000)) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM f JOIN b USING (w) JOIN gain USING (bucket) GROUP BY r),
x AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) END AS place, count(*) FILTER (n_features >= 20) OVER () AS may FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * may // 100 THEN place END AS rank FROM y
"""
