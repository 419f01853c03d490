"""Extraction against a row-by-row restatement on random texts."""

import random
import re

from pyspark.sql import functions as F

from assayflow.operators import extract

UNITS = [("mg/dl", "mg/dL"), ("g/dl", "g/dL")]
CATALOG = [
    ("hb", 0, "Hemoglobin", ["HGB", "hb"], "g/dL", None),
    ("glu", 1, "Glucose", [], "mg/dL", ["mg/dL", "mmol/L"]),
    ("odd", 2, "a+b (x)", ["hb"], None, None),
    ("none", 3, None, [], "", []),
]


def frames(spark):
    catalog = spark.createDataFrame(CATALOG, "id string, ord long, display_name string, aliases array<string>, unit string, units array<string>")
    return catalog, spark.createDataFrame(UNITS, "variant string, canonical string")


def restated(text):
    """All places of every name with a number behind it; then, of one name, those that don't begin inside a match before."""
    text = " ".join(text.split()).lower()
    units, value, out = dict(UNITS), re.compile(extract.VALUE, re.IGNORECASE), []
    named = [(i, n.lower(), u if u is not None else [unit] if unit else []) for i, _, display, aliases, unit, u in CATALOG for n in [display or i, *aliases]]
    places = [(id_, name, own, at, value.match(text, at + len(name))) for id_, name, own in named for at in range(len(text)) if text.startswith(name, at)]
    free = {}
    for id_, name, own, at, m in sorted((p for p in places if p[4]), key=lambda p: p[3]):
        if at >= free.get((id_, name), 0):
            free[id_, name] = m.end()
            raw = ((m[2] or own[0]) if own else "").strip().lower()
            out.append((id_, float(m[1].replace(",", "")), units.get(raw, raw)))
    return sorted(out)


def test_measurements(spark):
    rng = random.Random(5)
    words = ["Hemoglobin", "hgb:", "HB", "glucose -", "a+b (x)", "xhb", "none", "14.5", "1,200", "g/dl", "mg/dL", "12-16", "\n", ":", "%", "7.", "text"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    catalog, units = frames(spark)
    docs = spark.createDataFrame([*enumerate(texts), (1000, None)], "doc_id long, text string")
    got = {}
    for r in extract.extract_measurements(docs, catalog, units).collect():
        got.setdefault(r["doc_id"], []).append((r["id"], r["value"], r["unit"]))
    assert sum(map(len, got.values())) > 300
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == restated(t), t


def test_ranges_and_strict(spark):
    catalog = spark.createDataFrame(
        [("hb", 0, "hb", [], "g/dL", {"all": (0.0, 17.0), "male": (13.0, 18.0)}, 12.0, 16.0)],
        "id string, ord long, display_name string, aliases array<string>, unit string, ranges map<string,struct<min:double,max:double>>, normal_min double, normal_max double",
    )
    units = frames(spark)[1]
    docs = spark.createDataFrame([(1, "xhb 9 g/dl hb 10 apples hb 11 g/dl")], "doc_id long, text string")
    loose = extract.extract_measurements(docs, catalog, units).collect()
    assert [(r["value"], r["normal_min"], r["normal_max"]) for r in sorted(loose, key=lambda r: r["value"])] == [(9, 12, 17), (10, 12, 17), (11, 12, 17)]
    assert [r["value"] for r in extract.extract_measurements(docs, catalog, units, strict=True).collect()] == [11]


def test_entities_and_documents(spark):
    meds = spark.createDataFrame([("acetaminophen", 0, "Acetaminophen", "analgesic", ["paracetamol", "two words"])], "id string, ord long, display_name string, category string, aliases array<string>")
    catalog, units = frames(spark)
    docs = spark.createDataFrame([(1, "Patient prescribed Paracetamol 500mg, paracetamol."), (2, ""), (3, "Hemoglobin: 12.0 g/dL, paracetamol."), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in extract.parse_documents(docs, catalog, meds, units).collect()}
    assert [m["id"] for m in got[1]["medicines"]] == ["acetaminophen"] and got[1]["tests"] == []
    assert got[2]["tests"] == [] and got[2]["medicines"] == [] and got[4]["tests"] == []
    assert [(t["id"], t["value"], t["unit"]) for t in got[3]["tests"]] == [("hb", 12.0, "g/dL")]


def test_measurements_need_no_nested_loop(spark, capsys, monkeypatch):
    """All aliases are searched in one pass of a text: what overlaps, what a unit swallows, and aliases in several shards, more than a worker holds too."""
    catalog = spark.createDataFrame([("a", 0, "Iron", ["fe", "e"]), ("b", 1, "serum iron", ["b1"]), ("c", 2, "Iron", None)], "id string, ord long, display_name string, aliases array<string>").withColumn("unit", F.lit("mg/dl"))
    docs = spark.createDataFrame([(1, "Serum Iron: 5 mg/dl fe 7 fe 8 b12 3"), (2, None), (3, "iron 1,200.5 iron 6"), (4, "no value: iron")], "doc_id long, text string")
    units = spark.createDataFrame([("mg/dl", "mg/dL")], "variant string, canonical string")
    want = [
        (1, "a", "iron", 5.0, "mg/dL"), (1, "c", "iron", 5.0, "mg/dL"), (1, "b", "serum iron", 5.0, "mg/dL"), (1, "a", "fe", 7.0, "fe"), (1, "a", "e", 7.0, "fe"),
        (1, "b", "b1", 2.0, "3"), (3, "a", "iron", 1200.5, "iron"), (3, "c", "iron", 1200.5, "iron"),
    ]
    for most in (100_000, 2, 1):
        monkeypatch.setattr(extract, "ALIASES", most)
        shards = extract.alias_shards(catalog)
        assert shards[1] == {100_000: 1, 2: 3, 1: 5}[most]
        found = extract.extract_measurements(docs, catalog, units, shards=shards)
        rows = found.collect()
        assert len(rows) == len(want) and {(r["doc_id"], r["id"], r["value"], r["unit"]) for r in rows} == {(d, i, v, u) for d, i, _, v, u in want}
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and plan.split("Initial Plan")[0].count("MapInArrow") == 1
    assert extract.extract_measurements(docs, catalog.limit(0), units).count() == 0


def test_catalogs_are_the_sides_that_are_broadcast(spark, tmp_path):
    """The side that is exploded from documents, as small as its files may be, isn't sent to all executors; the counted catalog is."""
    meds = spark.createDataFrame([(f"m{i:04d}", i, f"Med {i}", "x", [f"brand{i:04d}"]) for i in range(50)], "id string, ord long, display_name string, category string, aliases array<string>")
    spark.createDataFrame([(i, f"takes m{i:04d} and brand{i:04d}") for i in range(60)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    hits = extract.extract_entities(spark.read.parquet(str(tmp_path / "docs")), meds)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert hits.count() == 50


def test_numbers_are_read_once_a_match(spark):
    """What is found is read before it is joined with the tests that share its alias, and lists of tests give the rows of the join."""
    catalog = spark.createDataFrame([(f"t{i}", i, f"test {i}", ["shared"], "mg/dl" if i % 3 else "") for i in range(9)], "id string, ord long, display_name string, aliases array<string>, unit string")
    docs = spark.createDataFrame([(1, "shared 5 g/dl, test 4: 1,000 shared 7."), (2, ""), (3, None)], "doc_id long, text string")
    units = frames(spark)[1]
    found = extract.extract_measurements(docs, catalog, units)
    rows = sorted(found.collect())
    assert len(rows) == 9 * 2 + 1 and {(r["value"], r["unit"]) for r in rows} == {(5.0, "g/dL"), (5.0, ""), (1000.0, "shared"), (7.0, "mg/dL"), (7.0, "")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("RLIKE")
    aliases = extract.tests_by_alias(catalog, units)
    matches = extract.measured_matches(docs, extract.alias_shards(aliases), units)
    assert matches.count() == 3
    assert sorted(extract.with_tests(matches, aliases, few=0).collect()) == sorted(extract.with_tests(matches, aliases).collect()) == rows
