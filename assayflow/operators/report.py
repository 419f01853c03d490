"""Classifying measurements and building reports by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.functions.text import filled, float_text
from assayflow.sources.shared import small

#: Wording of reports, here and in the questions, steps and summaries below.
DISCLAIMER = "This explanation is automated and not a medical diagnosis. Always consult your doctor."
PURPOSE = "Prescribed by your doctor."


def severity_columns(value: Column, low: Column, high: Column) -> dict[str, Column]:
    """is_abnormal, direction, deviation and severity. Bounds are normal; a bound of 0 gives no deviation."""
    known = value.isNotNull() & low.isNotNull() & high.isNotNull()
    below, above = known & (value < low), known & (value > high)
    share = lambda gap, bound: F.coalesce(gap / F.nullif(bound, F.lit(0.0)) * 100, F.lit(0.0))
    deviation = F.when(below, share(low - value, low)).when(above, share(value - high, high)).otherwise(0.0)
    abnormal = F.coalesce(below | above, F.lit(False))
    return {
        "is_abnormal": abnormal,
        "direction": F.when(below, "low").when(above, "high"),
        "deviation": deviation,
        "severity": F.when(~abnormal, "unknown").when(deviation > 50, "critical").when(deviation > 30, "severe").when(deviation > 15, "moderate").otherwise("mild"),
    }


def classify_severity(measurements: DataFrame, value: str = "value", low: str = "normal_min", high: str = "normal_max") -> DataFrame:
    """Adds is_abnormal, direction, deviation, severity (`unknown` for normal values and unknown ranges)."""
    return measurements.withColumns(severity_columns(*(F.col(c).cast("double") for c in (value, low, high))))


def enrich_measurements(measurements: DataFrame, catalog: DataFrame) -> DataFrame:
    """Measurements(id, name, value, unit, normal_min, normal_max) with severity and the wording of catalog(id, display_name, meaning, normal_meaning, common_causes)."""
    words = catalog.select(F.col("id").alias("__id"), F.col("display_name").alias("__display"), F.col("meaning").alias("__meaning"), F.col("normal_meaning").alias("__normal"), F.col("common_causes").alias("__causes"))
    m = classify_severity(measurements).join(small(words), F.col("id") == F.col("__id"), "left")
    name = F.coalesce(filled("__display"), filled("name"), F.lit("Unknown"))
    unit = F.coalesce("unit", F.lit(""))
    text = F.concat(F.coalesce(float_text(F.col("value")), F.lit("None")), F.lit(" "), unit)
    span = F.concat(float_text(F.col("normal_min")), F.lit("–"), float_text(F.col("normal_max")), F.lit(" "), unit)
    outside = F.concat(F.lit("This value is outside the normal range ("), F.when(F.col("direction") == "low", "below").otherwise("above"), F.lit(" normal)."))
    m = m.withColumn("name", name)
    level = F.when(F.col("direction") == "low", "low").otherwise("high")
    n = F.col("name")
    questions = F.array(
        F.concat(F.lit("What is causing my "), level, F.lit(" "), n, F.lit(" result?")),
        F.concat(F.lit("Is my "), n, F.lit(" level serious at this range?")),
        F.concat(F.lit("Do I need further tests for "), n, F.lit("?")),
        F.concat(F.lit("What lifestyle changes can help improve my "), n, F.lit("?")),
    )
    none = F.array().cast("array<string>")
    return m.withColumns(
        {
            "value_str": F.trim(text),
            "normal_range_str": F.coalesce(F.trim(span), F.lit("Not available")),
            "meaning": F.when(F.col("is_abnormal"), F.coalesce(filled("__meaning"), outside)).otherwise(F.coalesce(filled("__normal"), F.lit("This value is within the normal range."))),
            "common_causes": F.coalesce("__causes", none),
            "questions": F.when(F.col("is_abnormal"), questions).otherwise(none),
        }
    ).drop("__id", "__display", "__meaning", "__normal", "__causes")


def enrich_medicines(medicines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Medicines(id, name) with the texts of catalog(id, display_name, purpose, ...); lists are cut to 3, a missing purpose has a default."""
    texts, lists = ["generic_name", "mechanism", "how_to_take", "generic_alternative"], ["common_side_effects", "serious_side_effects", "drug_interactions", "precautions", "lifestyle_tips"]
    have = set(catalog.columns)
    opt = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    own = catalog.select(F.col("id").alias("__id"), F.col("display_name").alias("__display"), opt("purpose", "string").alias("__purpose"), *[opt(c, "string").alias(c) for c in texts], *[opt(c, "array<string>").alias(c) for c in lists])
    base = medicines.drop(*texts, *lists, "purpose")
    m = base.join(small(own), F.col("id") == F.col("__id"), "left")
    cut = {c: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 3) for c in lists}
    return m.withColumns({"name": F.coalesce(filled("__display"), "name"), "purpose": F.coalesce(filled("__purpose"), F.lit(PURPOSE)), **cut}).drop("__id", "__display", "__purpose")


def report_counts(measurements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc_id, abnormal, normal, worst (0 to 4, mild is 1) of classified measurements."""
    rank = F.when(F.col("is_abnormal"), F.array_position(F.array(*[F.lit(s) for s in ("mild", "moderate", "severe", "critical")]), F.col("severity"))).otherwise(0)
    return measurements.groupBy(doc).agg(F.count_if("is_abnormal").alias("abnormal"), F.count_if(~F.col("is_abnormal")).alias("normal"), F.max(rank.cast("int")).alias("worst"))


def document_counts(reports: DataFrame) -> DataFrame:
    """Counts of a result document's lists, and its confidence in per cent."""
    return reports.select("job_id", F.size("doc.abnormal_values").alias("abnormal"), F.size("doc.normal_values").alias("normal"), F.size("doc.medicines").alias("medicines"), F.round(F.col("doc.confidence_score") * 100).cast("int").alias("confidence_percent"))


#: Severities that call for advice at once.
URGENT = ("severe", "critical")


def first_questions(lists: Column, most: int = 8) -> Column:
    """The questions of lists in order, each once, the first `most`."""
    return F.slice(F.array_distinct(F.flatten(lists)), 1, most)


def steps(abnormal: Column, urgent: Column) -> Column:
    """What to do, by whether anything is abnormal and how badly."""
    bad = F.array_compact(F.array(F.lit("Consult your doctor within 1–2 weeks"), F.when(urgent, "Seek medical advice urgently"), F.lit("Repeat abnormal tests if advised")))
    return F.when(abnormal, bad).otherwise(F.array(F.lit("Continue healthy habits"), F.lit("Repeat routine tests in 6–12 months")))


def build_questions(enriched: DataFrame, doc: str = "doc_id", order: tuple = ("pos",), most: int = 8) -> DataFrame:
    """doc_id, questions: those of the abnormal values in order, each once, the first `most`."""
    rows = F.array_sort(F.collect_list(F.when(F.col("is_abnormal"), F.struct(*order, "questions"))))
    return enriched.groupBy(doc).agg(first_questions(F.transform(rows, lambda r: r["questions"]), most).alias("questions"))


def build_next_steps(enriched: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc_id, next_steps of its values."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return enriched.groupBy(doc).agg(steps(some(F.col("is_abnormal")), some(F.col("is_abnormal") & F.col("severity").isin(*URGENT))).alias("next_steps"))


def rule_based_report(docs: DataFrame, measurements: DataFrame, medicines: DataFrame, tests: DataFrame, drugs: DataFrame, order: tuple = ("pos",), drug_order: tuple = ("first_pos", "ord")) -> DataFrame:
    """doc_id and the fields of a report for every one of docs(doc_id), from its measurements and medicines alone."""
    m = enrich_measurements(measurements, tests)
    entry = F.struct(F.col("name").alias("test_name"), F.col("value_str").alias("value"), F.col("normal_range_str").alias("normal_range"), "severity", F.col("meaning").alias("what_it_means"), "common_causes", F.col("questions").alias("what_to_ask_doctor"))
    in_order = lambda rows: F.transform(F.array_sort(rows), lambda r: r["entry"])
    m = m.withColumn("entry", entry)
    pick = lambda c: in_order(F.collect_list(F.when(c, F.struct(*order, "entry"))))
    values = m.groupBy("doc_id").agg(pick(F.col("is_abnormal")).alias("abnormal_values"), pick(~F.col("is_abnormal")).alias("normal_values"))
    values = values.withColumn("normal_values", F.transform("normal_values", lambda e: e.dropFields("severity", "common_causes", "what_to_ask_doctor")))
    block = F.struct("name", "generic_name", "purpose", "mechanism", "how_to_take", "common_side_effects", "serious_side_effects", "drug_interactions", "precautions", "generic_alternative", "lifestyle_tips")
    meds = enrich_medicines(medicines, drugs).withColumn("entry", block).groupBy("doc_id").agg(in_order(F.collect_list(F.struct(*drug_order, "entry"))).alias("medicines"))
    out = docs.select("doc_id").join(values, "doc_id", "left").join(meds, "doc_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))
    out = out.select("doc_id", *[none(c).alias(c) for c in ("abnormal_values", "normal_values", "medicines")])
    # Questions and steps follow from the abnormal values, which are in order already.
    bad = F.col("abnormal_values")
    n = F.size(bad)
    summary = F.when(n > 0, F.concat(n.cast("string"), F.lit(" value(s) are outside the normal range."))).otherwise("All detected values are within normal ranges.")
    return out.select(
        "doc_id", F.lit(DISCLAIMER).alias("disclaimer"), "abnormal_values", "normal_values", "medicines", summary.alias("overall_summary"), F.lit("routine").alias("urgency_level"),
        first_questions(F.transform(bad, lambda e: e["what_to_ask_doctor"])).alias("questions_to_ask_doctor"), steps(n > 0, F.exists(bad, lambda e: e["severity"].isin(*URGENT))).alias("next_steps"),
        F.lit(0.25).cast("double").alias("confidence_score"),
    )
