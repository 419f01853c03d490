"""Column functions for text, numbers, units, keys and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.sources.shared import small

_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def filled(value: Column | str, *empty: object) -> Column:
    """Null where a value is null or one of the empty ones: what an `or` would skip."""
    c = F.col(value) if isinstance(value, str) else value
    return reduce(lambda a, e: F.nullif(a, F.lit(e)), empty or ("",), c)


def normalize_text(text: Column) -> Column:
    """White space runs, of any script, as one space; trimmed; lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def parse_number(text: Column) -> Column:
    """A double from text with thousands commas; null for anything that isn't a number. `1_000` is not one."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(plain.rlike(_NUMBER), F.trim(plain).try_cast("double"))


def normalize_unit(df: DataFrame, units: DataFrame, unit: str = "unit", out: str = "unit_normalized") -> DataFrame:
    """The canonical spelling of units(variant, canonical), or the lower-case unit as it is."""
    key = F.lower(F.trim(F.col(unit)))
    u = units.select(F.col("variant").alias("__variant"), F.col("canonical").alias("__canonical")).dropDuplicates(["__variant"])
    return df.join(small(u), key == F.col("__variant"), "left").withColumn(out, F.coalesce("__canonical", key)).drop("__variant", "__canonical")


def resolve_name(names: DataFrame, synonyms: DataFrame, aliases: DataFrame, name: str = "name", out: str = "entity_id") -> DataFrame:
    """The id of a name: by synonyms(alias, id), then as a catalog id, then by aliases(id, ord, alias), the first in catalog order."""
    key = F.lower(F.trim(F.col(name)))
    syn = synonyms.groupBy(F.lower("alias").alias("__k1")).agg(F.min("id").alias("__by_synonym"))
    own = aliases.select(F.col("id").alias("__k2")).distinct().withColumn("__by_id", F.col("__k2"))
    first = aliases.groupBy(F.lower("alias").alias("__k3")).agg(F.min_by("id", "ord").alias("__by_alias"))
    joined = names.withColumn("__key", key)
    for side, k in ((syn, "__k1"), (own, "__k2"), (first, "__k3")):
        joined = joined.join(small(side), F.col("__key") == F.col(k), "left")
    return joined.withColumn(out, F.coalesce("__by_synonym", "__by_id", "__by_alias")).drop("__key", "__k1", "__k2", "__k3", "__by_synonym", "__by_id", "__by_alias")


def entity_key(name: Column, drug: bool = False) -> Column:
    """A catalog key. Lab: runs of other characters as one underscore, none at the ends. Drug: only spaces and slashes, each by itself."""
    if drug:
        return F.translate(F.lower(name), " /", "__")
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def content_id(text: Column) -> Column:
    return F.md5(text)


def truncate_indication(text: Column) -> Column:
    """Over 300 characters: up to the first full stop at or after offset 40, if there is one."""
    stop = F.locate(".", text, 41)
    return F.when((F.length(text) > 300) & (stop > 0), F.substr(text, F.lit(1), stop)).otherwise(text)


def truncate_words(text: Column, most: int = 200) -> Column:
    """Over `most` characters: that many, without what follows the last space, and three dots."""
    cut = F.regexp_replace(F.substring(text, 1, most), r"(?s) [^ ]*$", "")
    return F.when(F.length(text) > most, F.concat(cut, F.lit("..."))).otherwise(text)


def title_case(text: Column) -> Column:
    """Upper case after anything that is not a letter, lower case elsewhere (`Co-Trimoxazole`)."""
    parts = F.split(F.lower(text), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def float_text(value: Column) -> Column:
    """A double as Python prints it: `15000000.0`, `0.0005`, `1e+20`, `1.5e-07`; but for the least denormal one, `4.9e-324`."""
    d = value.cast("double")
    plain = d.cast("string")
    wide = F.regexp_replace(F.regexp_replace(plain.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.regexp_extract(plain, "^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(plain, "E-?([0-9]+)$", 1)
    scientific = F.concat(mantissa, F.when(plain.contains("E-"), "e-").otherwise("e+"), F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    size = F.abs(d)
    return (
        F.when(F.isnan(d), "nan")
        .when(size == float("inf"), F.when(d > 0, "inf").otherwise("-inf"))
        .when(~plain.contains("E"), plain)
        .when((size >= 1e-4) & (size < 1e16), wide)
        .otherwise(scientific)
    )
