"""Fill-in-middle: a text's middle moves to its end, cut at whole units that a Fenwick tree over blocks of the text finds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Production parameters: seed, per cent of texts that are cut, per cent of those whose suffix comes first.
SEED, RATE, SPM = 7, 100, 50
#: Bytes of a block of the tree.
BLOCK = 1024
CUTS = "n long, first long, second long, prefix_chars long, middle_chars long"


def line_ends(data: np.ndarray) -> np.ndarray:
    """True at the last byte of each line; what follows the last line end is a line too."""
    ends = data == 10
    ends[-1:] = True
    return ends


def char_ends(data: np.ndarray) -> np.ndarray:
    """True at the last byte of each code point of UTF-8."""
    return np.append((data[1:] & 0xC0) != 0x80, np.ones(min(1, len(data)), bool))


UNITS = {"line": line_ends, "char": char_ends}


class Blocks:
    """Counts of units and code points over fixed blocks of a text's bytes, as a Fenwick tree."""

    def __init__(self, data: np.ndarray, unit: str = "line", size: int = BLOCK):
        self.size, self.ends, self.chars = size, UNITS[unit](data), (data & 0xC0) != 0x80
        at = np.arange(0, len(data), size)
        self.n = len(at)
        self.tree = np.zeros((self.n + 1, 2), np.int64)
        if self.n:
            self.tree[1:, 0] = np.add.reduceat(self.ends, at, dtype=np.int64)
            self.tree[1:, 1] = np.add.reduceat(self.chars, at, dtype=np.int64)
        step = 1
        while 2 * step <= self.n:  # node i sums up the blocks from i - (its lowest bit) to i
            self.tree[2 * step :: 2 * step] += self.tree[step : self.n + 1 - step : 2 * step]
            step *= 2

    def units(self) -> int:
        """Units of the whole text: the sum of the nodes that make up all blocks."""
        total, i = 0, self.n
        while i:
            total += int(self.tree[i, 0])
            i &= i - 1
        return total

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first k units: binary lifting down to the block that holds the k-th unit's end, then a look inside it."""
        if k == 0:
            return 0, 0
        block, left, chars = 0, k, 0
        step = 1 << max(0, self.n.bit_length() - 1)
        while step:
            node = block + step
            if node <= self.n and self.tree[node, 0] < left:
                block, left, chars = node, left - int(self.tree[node, 0]), chars + int(self.tree[node, 1])
            step >>= 1
        at = block * self.size
        end = at + int(np.flatnonzero(self.ends[at : at + self.size])[left - 1]) + 1
        return end, chars + int(np.count_nonzero(self.chars[at:end]))


def find_cuts(unit: str):
    """A function of (text as UTF-8, h1, h2) -> n units, both cuts in bytes, and code points of prefix and middle."""

    @F.arrow_udf(CUTS)
    def cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        out = np.zeros((5, len(text)), np.int64)
        for k, (t, a, b) in enumerate(zip(text, h1.to_pylist(), h2.to_pylist(), strict=True)):
            buffer = t.as_buffer()
            if buffer is None or buffer.size == 0:
                continue
            blocks = Blocks(np.frombuffer(buffer, np.uint8), unit)
            n = blocks.units()
            a, b = sorted((a % (n + 1), b % (n + 1)))
            (first, before), (second, upto) = blocks.cut(a), blocks.cut(b)
            out[:, k] = n, first, second, before, upto - before
        return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "first", "second", "prefix_chars", "middle_chars"])

    return cuts


def hash_group(digest: Column, k: int) -> Column:
    """The k-th group (from 1) of eight hex digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = "line", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output.

    n is the number of units of the text: lines with their ends, or code points (`char`). Two cuts, drawn from a
    hash of seed and id, part it into prefix, middle and suffix, each of any length from nothing on. form is `psm`
    (prefix, suffix, middle), `spm` (suffix first) or `plain`: the text as it is, if it is empty, holds one
    of the marks, or isn't drawn. Code points are null if plain. A null text is empty; a null id hashes as
    nothing after the seed; rows of one id and text are cut alike. Columns of those names are replaced, all
    others pass through, and no row moves: there is no shuffle. Only cuts come back from Python; the output is put
    together from the bytes by Spark.
    """
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    whole = F.coalesce(F.col(text), F.lit(""))
    data = whole.cast("binary")
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    plain = (whole == "") | marked | (F.col("__digest.h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("__digest.h4") % 100 < spm, "spm").otherwise("psm")
    rows = docs.withColumn("__digest", F.struct(*[hash_group(digest, k).alias(f"h{k}") for k in (1, 2, 3, 4)]))
    rows = rows.withColumn("__cut", find_cuts(unit)(data, F.col("__digest.h1"), F.col("__digest.h2"))).withColumn("form", form)
    first, second = F.col("__cut.first").cast("int"), F.col("__cut.second").cast("int")
    part = lambda a, b: F.substring(data, a + 1, b - a).cast("string")
    prefix, middle, suffix = part(F.lit(0), first), part(first, second), part(second, F.octet_length(data))
    spm_text = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    psm_text = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("__cut.n").alias("n"),
        "form",
        F.when(cut, F.col("__cut.prefix_chars")).alias("prefix_chars"),
        F.when(cut, F.col("__cut.middle_chars")).alias("middle_chars"),
        F.when(~cut, whole).when(F.col("form") == "spm", spm_text).otherwise(psm_text).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of: no part holds a mark, so the marks part it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.concat(part(1), part(3), part(2)))


def digest(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it."""
    done = fill_in_middle(docs, **parameters)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
