"""Catalog building against row-by-row restatements."""

import random

from pyspark.sql import functions as F

from assayflow.operators import catalog
from assayflow.sources import codes, files


def restated(rows, most):
    priority, other = {}, {}
    for key, row_no, component, first in rows:
        if key in other:
            continue
        (priority if first else other)[key] = row_no
    result = dict(priority)
    for key in list(other)[: most - len(priority)]:
        result.setdefault(key, other[key])
    return result


def test_resolve(spark):
    rng = random.Random(3)
    for most in (0, 3, 8, 100):
        rows = [(f"k{rng.randrange(12)}", i, "c", rng.random() < 0.4) for i in range(40)]
        df = spark.createDataFrame(rows, "key string, row_no long, COMPONENT string, first boolean")
        got = catalog.resolve_lab_catalog(df, most, F.col("first"))
        assert {r["key"]: r["row_no"] for r in got.collect()} == restated(rows, most), (most, rows)


def test_lab_codes_file(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text('﻿LOINC_NUM,COMPONENT,STATUS\n1,"Glucose, ""fasting""",ACTIVE\n2,,\n', encoding="utf-8")
    rows = codes.read_lab_codes(spark, str(path)).orderBy("row_no").collect()
    assert [tuple(r) for r in rows] == [("1", 'Glucose, "fasting"', "ACTIVE", 0), ("2", "", "", 1)]


def test_catalog_file(spark, tmp_path):
    path = tmp_path / "tests.json"
    path.write_text('{"_meta": {"category": "x"}, "b": {"normal_min": 70, "normal_max": 12.0, "aliases": ["B"]}, "a": {"display_name": "A"}, "c": "text"}')
    rows = files.read_catalog(spark, str(path)).orderBy("ord").collect()
    assert [r["id"] for r in rows] == ["b", "a"]
    assert (rows[0]["entry"]["normal_min"], rows[0]["entry"]["normal_max"]) == ("70", "12.0")


def test_ranges_and_categories(spark):
    df = spark.createDataFrame([("Hemoglobin A1c", "Bld", "u"), ("Cholesterol in HDL", "Ser", "u"), ("Zinc", "Urine", "u"), ("Glucose", "ur", "")], "COMPONENT string, SYSTEM string, unit string")
    got = catalog.attach_reference_ranges(df).select("COMPONENT", "normal_max", "unit", "ranges", catalog.infer_category(F.col("COMPONENT"), F.col("SYSTEM")).alias("c")).collect()
    by = {r["COMPONENT"]: r for r in got}
    assert (by["Hemoglobin A1c"]["normal_max"], by["Hemoglobin A1c"]["unit"], by["Hemoglobin A1c"]["c"]) == (17.0, "g/dL", "cbc")
    assert by["Hemoglobin A1c"]["ranges"]["male"]["min"] == 13.0
    assert (by["Cholesterol in HDL"]["normal_max"], by["Zinc"]["normal_max"], by["Zinc"]["unit"], by["Zinc"]["c"], by["Glucose"]["c"]) == (200.0, None, "u", "urine", "urine")


def test_brands_and_synonyms(spark):
    curated = spark.createDataFrame([("Drug A", "Calpol", 0), ("Drug A", "calpol", 1)], "drug string, brand string, ord long")
    fetched = spark.createDataFrame([("Drug A", "CALPOL", 0), ("Drug A", "Tylenol", 1), ("Drug A", "tylenol", 2)], "drug string, brand string, ord long")
    drugs = spark.createDataFrame([("Drug A",), ("tylenol",)], "drug string")
    got = {r["drug"]: r["aliases"] for r in catalog.merge_brands(curated, fetched, drugs).collect()}
    assert got == {"Drug A": ["Calpol", "calpol", "Tylenol", "drug a"], "tylenol": ["tylenol"]}
    tests = spark.createDataFrame([("a", 0, ["X", " y ", "a", ""]), ("b", 1, ["x"]), ("_m", 2, ["z"])], "id string, ord long, aliases array<string>")
    meds = spark.createDataFrame([("m", 0, ["Y"])], "id string, ord long, aliases array<string>")
    assert {r["alias"]: r["id"] for r in catalog.build_synonyms(tests, meds).collect()} == {"x": "b", "y": "m"}
    existing = spark.createDataFrame([("x", "old")], "alias string, id string")
    assert {r["alias"]: (r["id"], r["added"]) for r in catalog.extend_synonyms(existing, tests).collect()} == {"x": ("old", False), "y": ("a", True), "a": ("a", True), "z": ("_m", True)}
