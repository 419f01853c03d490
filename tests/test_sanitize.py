"""Result cleaning, with the cases that the rules single out."""

import json
import random

from pyspark.sql import functions as F

from assayflow.operators import responses, sanitize


def clean(spark, raws):
    df = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(raws)], "i long, raw string")
    out = sanitize.sanitize_results(df).select("i", F.to_json("doc", {"ignoreNullFields": "false"}).alias("j"))
    return [json.loads(r["j"]) for r in out.orderBy("i").collect()]


def test_scalars(spark):
    raws = ['"  x "', "5.0", "5", "true", "null", "[1]", "{}", "1e20", "0.5"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i long, r string").withColumn("v", F.parse_json("r"))
    got = [r["y"] for r in df.select("i", sanitize.ensure_str(F.col("v"), "d").alias("y")).orderBy("i").collect()]
    assert got == ["x", "5.0", "5", "True", "d", "d", "d", "1e+20", "0.5"]
    got = [r["y"] for r in df.select("i", F.size(sanitize.ensure_list(F.col("v"))).alias("y")).orderBy("i").collect()]
    assert got == [1, 1, 1, 1, 0, 1, 1, 1, 1]


def test_documents(spark):
    raws = [
        {},
        '"a bare string"',
        {"urgency_level": "CRITICAL_DANGER", "confidence_score": "0.75"},
        {"confidence_score": "not-a-number", "urgency_level": " Soon "},
        {"abnormal_values": [{"test_name": "T", "severity": "BANANA"}, {"value": "1 tablet daily"}, "oops", {}]},
        {"normal_values": [{"test_name": "N", "severity": "mild"}]},
        {"medicines": [{"name": "M", "common_side_effects": ["a", "b", "c", "d"], "mechanism": 5}, "not a dict"]},
        {"metadata": None, "normal_values": None},
        {"input_summary": {"document_type": "My Prescription"}, "abnormal_values": [{"value": "3"}], "normal_values": [{}]},
        {"metadata": {"processing_time_sec": "12", "cached": "false", "model": "m"}, "pattern_analysis": {}, "lifestyle_action_plan": {"a": 1}},
        {"metadata": "text", "disclaimer": "kept?"},
        {"normal_values": [1], "disclaimer": "kept?"},
    ]
    d = clean(spark, raws)
    assert d[0]["overall_summary"] == "No data available" and d[0]["metadata"]["model"] == "unknown" and d[0] == d[1]
    assert d[2]["urgency_level"] is None and d[2]["confidence_score"] == 0.75
    assert d[3]["confidence_score"] == 0.0 and d[3]["urgency_level"] == "soon"
    assert [(e["test_name"], e["severity"]) for e in d[4]["abnormal_values"]] == [("T", "unknown"), ("Unknown", "mild"), ("Unknown", "mild")]
    assert d[5]["normal_values"] == [{"test_name": "N", "value": "", "normal_range": "", "what_it_means": ""}]
    assert [m["name"] for m in d[6]["medicines"]] == ["M", "Unknown"] and d[6]["medicines"][0]["common_side_effects"] == ["a", "b", "c"] and d[6]["medicines"][0]["mechanism"] == "5"
    assert d[7] == d[0] and d[10] == d[0] and d[11] == d[0]
    assert d[8]["abnormal_values"] == [] and d[8]["normal_values"] == []
    assert d[9]["metadata"]["processing_time_sec"] == 12 and d[9]["metadata"]["cached"] is True and d[9]["pattern_analysis"] is None and d[9]["lifestyle_action_plan"] == {"a": 1}
    again = clean(spark, d)
    assert again == d


def test_conform(spark):
    raws = [{"next_steps": ["a"]}, {"next_steps": [1]}, {"pattern_analysis": "text"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)], "i long, raw string")
    out = sanitize.conform_results(sanitize.sanitize_results(df)).orderBy("i")
    assert [r["conforms"] for r in out.select("i", "conforms").orderBy("i").collect()] == [True, False, False]


def test_repair(spark):
    whole = '{"a": 1}'
    texts = [whole, f"x\n```json\n{whole}\n```", f"```\n{whole}```", f"Sure {whole} done", '{"a": 1', "} {", "7", "[1]", '{"a": NaN}']
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = [(r["repair_stage"], r["error"]) for r in responses.repair_json(df).orderBy("i").select("repair_stage", "error", "i").collect()]
    assert got == [("whole", None), ("fence", None), ("fence", None), ("braces", None), (None, "truncated"), (None, "truncated"), ("whole", None), ("whole", None), (None, "invalid")]
    full = {k: "x" for k in responses.REQUIRED} | {"confidence_score": 0.5}
    part = {k: v for k, v in full.items() if k != "medicines"}
    df = spark.createDataFrame([(0, json.dumps(full)), (1, json.dumps(part)), (2, json.dumps(full | {"confidence_score": "x"}))], "i long, text string")
    got = [r["schema_error"] for r in responses.require_keys(responses.repair_json(df)).orderBy("i").select("i", "schema_error").collect()]
    assert got == [None, "missing key: medicines", "confidence_score must be a number"]


def plain(raw):
    """A document cleaned by the rules, one field after the other."""

    def text(v, default):
        if isinstance(v, str):
            return v.strip()
        return str(v) if isinstance(v, (bool, int, float)) else default

    def many(v):
        return v if isinstance(v, list) else [] if v is None else [v]

    def number(v, kind, none):
        try:
            return kind(v) if isinstance(v, (bool, int, float, str)) else none
        except ValueError:
            return none

    def entry(e, abnormal):
        e = e if isinstance(e, dict) else {}
        out = {n: text(e.get(n), d) for n, d in sanitize.TEST_TEXTS}
        if abnormal:
            severity = text(e.get("severity"), "mild").lower()
            out |= {"severity": severity if severity in sanitize.SEVERITY else "unknown"} | {n: many(e.get(n)) for n in sanitize.TEST_LISTS}
        return out

    def medicine(m):
        m = m if isinstance(m, dict) else {}
        out = {"name": text(m.get("name"), "Unknown"), "purpose": text(m.get("purpose"), sanitize.NO_PURPOSE)} | {n: text(m.get(n), None) for n in ("mechanism", "how_to_take", "cost_saving_tip")}
        return out | {n: m.get(n) for n in ("generic_name", "generic_alternative")} | {n: many(m.get(n))[:3] for n in sanitize.MEDICINE_LISTS}

    doc = raw if isinstance(raw, dict) else {}
    bad = "normal_values" in doc and (not isinstance(doc["normal_values"], list) or any(not isinstance(e, dict) for e in doc["normal_values"]))
    if bad or any(doc.get(n) and not isinstance(doc[n], dict) for n in ("metadata", "input_summary")):
        doc = {}
    meta, summary = (doc.get(n) if isinstance(doc.get(n), dict) else {} for n in ("metadata", "input_summary"))
    kind = text(summary.get("document_type"), "unknown")
    rx = "prescription" in kind.lower() or kind.lower() == "rx"
    urgency = text(doc.get("urgency_level"), "").lower()
    abnormal = [e for e in many(doc.get("abnormal_values")) if not (isinstance(e, dict) and "tablet" in json.dumps(e.get("value")))]
    return {
        "disclaimer": text(doc.get("disclaimer"), ""), "overall_summary": text(doc.get("overall_summary"), "No data available"), "confidence_score": number(doc.get("confidence_score"), float, 0.0),
        "urgency_level": urgency if urgency in sanitize.URGENCY else None, **{n: doc.get(n) or None for n in ("pattern_analysis", "lifestyle_action_plan")},
        **{n: many(doc.get(n)) for n in ("questions_to_ask_doctor", "next_steps", "red_flags")},
        "metadata": {"processing_time_sec": number(meta.get("processing_time_sec"), int, 0), **{n: text(meta.get(n), "unknown") for n in ("ocr_engine", "llm_provider", "model")}, "cached": bool(meta.get("cached"))},
        "input_summary": {**{n: text(summary.get(n), "unknown") for n in ("document_type", "detected_language")}, **{n: summary.get(n) for n in ("detected_hospital", "date_of_report")}},
        "abnormal_values": [] if rx else [entry(e, True) for e in abnormal], "normal_values": [] if rx else [entry(e, False) for e in many(doc.get("normal_values"))],
        "medicines": [medicine(m) for m in many(doc.get("medicines"))],
    }


def test_random_documents(spark):
    """Against plain Python, and by one small expression: typing a value is said once a list and once a header."""
    rng = random.Random(8)

    def value(depth=0):
        k = rng.randrange(11)
        if k > 8 and depth < 2:
            return [value(depth + 1) for _ in range(rng.randrange(3))] if k == 9 else {"a": value(depth + 1)}
        return [None, True, False, 0, 7, -3.5, 0.5, "", rng.choice([" x ", "12", "Soon", "severe", "0.5", "rx", "1 tablet"]), [], {}][k]

    some = lambda names: {n: value() for n in names if rng.random() < 0.6}
    tests, meds = [n for n, _ in sanitize.TEST_TEXTS] + ["severity", *sanitize.TEST_LISTS], ["name", "purpose", "mechanism", "generic_name", "how_to_take", *sanitize.MEDICINE_LISTS]
    raws = [value() for _ in range(20)]
    for _ in range(300):
        d = some(sanitize.HEADER) | {n: some(names) for n, names in (("metadata", sanitize.METADATA), ("input_summary", sanitize.SUMMARY)) if rng.random() < 0.8}
        d |= {n: [some(names) if rng.random() < 0.95 else value() for _ in range(rng.randrange(3))] for n, names in (("abnormal_values", tests), ("normal_values", tests), ("medicines", meds)) if rng.random() < 0.8}
        raws.append(d)
    got = clean(spark, [json.dumps(r) for r in raws])
    assert got == [plain(r) for r in raws]
    assert sum(g != got[0] for g in got) > 150
    column = sanitize.sanitize_column(F.parse_json(F.lit("{}")))
    assert str(column._jc.toString()).count("schema_of_variant") < 12
