"""Scalar functions on whole columns, against plain Python."""

import math

from pyspark.sql import functions as F

from assayflow.functions import text as fx


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers(spark):
    raw = ["42", "12.5", "4,500", "  7.2 ", "abc", None, "", "12.", "1d", "1e3", "-3", "."]
    assert column(spark, raw, fx.parse_number) == [42, 12.5, 4500, 7.2, None, None, None, 12, None, 1000, -3, None]


def test_normalize_text(spark):
    assert column(spark, [" A  B\n", None, ""], fx.normalize_text) == ["a b", None, ""]


def test_keys(spark):
    assert column(spark, ["Hemoglobin A1c / Total", "__x__", ""], fx.entity_key) == ["hemoglobin_a1c_total", "x", ""]
    assert column(spark, ["a / b"], lambda c: fx.entity_key(c, drug=True)) == ["a___b"]


def test_title_case(spark):
    raw = ["co-trimoxazole acid", "vitamin b12x", "o'neil", "", None, "éCOLE 3d"]
    assert column(spark, raw, fx.title_case) == [x if x is None else x.title() for x in raw]


def test_float_text(spark):
    raw = [0.0, 1.0, 15000000.0, 0.0005, 1e20, 1.5e-7, 123456.789, 1e16, 9999999999999998.0, -2.5e-5, 0.1 + 0.2, 1e-4, 1e22, math.inf]
    assert column(spark, raw, fx.float_text, "double") == [repr(x) for x in raw]


def test_truncations(spark):
    long = "x" * 39 + ". " + "y" * 100 + ". " + "z" * 200
    raw = [long, long[:300], "n" * 301, None]
    dot = long.find(".", 40)
    assert column(spark, raw, fx.truncate_indication) == [long[: dot + 1], long[:300], "n" * 301, None]
    words = ["ab " * 100, "q" * 250, "short", None]
    want = [w if w is None or len(w) <= 200 else w[:200].rsplit(" ", 1)[0] + "..." for w in words]
    assert column(spark, words, fx.truncate_words) == want


def test_units_and_names(spark):
    units = spark.createDataFrame([("g/dl", "g/dL"), ("mg/dl", "mg/dL")], "variant string, canonical string")
    got = fx.normalize_unit(spark.createDataFrame([("g/dl",), ("foobar",), ("  mg/dl  ",)], "unit string"), units)
    assert {r["unit"]: r["unit_normalized"] for r in got.collect()} == {"g/dl": "g/dL", "foobar": "foobar", "  mg/dl  ": "mg/dL"}
    synonyms = spark.createDataFrame([("hgb", "hemoglobin")], "alias string, id string")
    aliases = spark.createDataFrame([("hemoglobin", 0, "hb"), ("wbc_count", 1, "WBC"), ("other", 2, "wbc")], "id string, ord long, alias string")
    got = fx.resolve_name(spark.createDataFrame([("hemoglobin",), ("HGB ",), ("WBC",), ("madeup",)], "name string"), synonyms, aliases)
    assert {r["name"]: r["entity_id"] for r in got.collect()} == {"hemoglobin": "hemoglobin", "HGB ": "hemoglobin", "WBC": "wbc_count", "madeup": None}
