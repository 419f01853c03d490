"""Cleaning of semi-structured result documents, as expressions on variants."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.functions.text import float_text

#: Words of dosages, and the enumerations of the schema.
DOSAGE = [
    "tablets?", "tab", "capsules?", "cap", "sachet", "drop", "drops", "syrup", "injection", "inj", "patch", "cream", "ointment", "gel", "inhaler", "spray",
    "suppository", "lotion", "solution", "once", "twice", "thrice", "daily", "weekly",
]
URGENCY = ["routine", "soon", "urgent", "emergency"]
SEVERITY = ["mild", "moderate", "severe", "critical", "low", "high", "unknown"]
TEST_TEXTS = [("test_name", "Unknown"), ("value", ""), ("normal_range", ""), ("what_it_means", "")]
TEST_LISTS = ["common_causes", "what_to_ask_doctor", "health_risks", "lifestyle_recommendations", "dietary_recommendations"]
NO_SUMMARY, NO_PURPOSE = "No data available", "Prescribed by your doctor."


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once: a lambda's variable stands for it, so nested expressions stay small."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def kind(v: Column) -> Column:
    """The JSON kind of a variant: null, object, array, string, boolean, int or float."""

    def of(t: Column) -> Column:
        head = F.when(t.isNull() | (t == "VOID"), "null").when(F.startswith(t, F.lit("OBJECT")), "object").when(F.startswith(t, F.lit("ARRAY")), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
        # `5.0` is kept as DECIMAL(1,0); whole numbers are decimals only beyond 64 bits.
        return head.when(t.isin("DOUBLE", "FLOAT") | (F.startswith(t, F.lit("DECIMAL")) & ~t.rlike(r"\((19|[23]\d),0\)")), "float").otherwise("int")

    return let(F.schema_of_variant(v), of)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _as(v: Column, t: str) -> Column:
    return F.try_variant_get(v, "$", t)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def typed(v: Column) -> Column:
    """What the rules ask of a value, made once: kind, text (of a scalar, as Python writes it, stripped if it is text), number, and the variant itself as v."""

    def of(k: Column) -> Column:
        def put(d: Column) -> Column:
            text = F.when(k == "string", _strip(_as(v, "string"))).when(k == "boolean", F.initcap(_as(v, "string"))).when(k == "float", float_text(d)).when(k == "int", _as(v, "string"))
            return F.struct(k.alias("kind"), text.alias("text"), d.alias("number"), v.alias("v"))

        return let(F.when(k.isin("int", "float"), _as(v, "double")), put)

    return let(kind(v), of)


def fields(doc: Column, paths: list[str], f: Callable[[Callable[[str], Column]], Column]) -> Column:
    """f of a function that gives the typed value at each of the paths of a variant; one expression types them all."""
    return let(F.transform(F.array(*[field(doc, p) for p in paths]), typed), lambda t: f(lambda p: F.get(t, F.lit(paths.index(p)))))


def falsy(t: Column) -> Column:
    """What Python takes for false of typed values: null, false, zero, and empty text, list or object."""
    k = F.coalesce(t["kind"], F.lit("null"))
    return F.when(k == "null", True).when(k == "string", _as(t["v"], "string") == "").when(k == "boolean", t["text"] == "False").when(k.isin("int", "float"), t["number"] == 0).otherwise(F.to_json(t["v"]).isin("[]", "{}"))


def text_of(t: Column, default: str | None = "") -> Column:
    return F.coalesce(t["text"], F.lit(default)) if default is not None else t["text"]


def list_of(t: Column) -> Column:
    none = F.array().cast("array<variant>")
    return F.when(t["kind"] == "array", _as(t["v"], "array<variant>")).when(F.coalesce(t["kind"], F.lit("null")) == "null", none).otherwise(F.array(t["v"]))


def ensure_str(v: Column, default: str | None = "") -> Column:
    """Text of a scalar as Python writes it, stripped if it is text; the default for null, lists and objects."""
    return let(let(v, typed), lambda t: text_of(t, default))


def ensure_list(v: Column) -> Column:
    """A list as it is, null as an empty one, anything else as a list of one."""
    return let(let(v, typed), list_of)


def float_of(t: Column) -> Column:
    """float() of typed values: numbers, booleans and numeric text; 0.0 otherwise."""
    plain = F.replace(t["text"], F.lit("_"), F.lit(""))
    number = F.when(plain.rlike(r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"), plain.try_cast("double"))
    flag = F.when(t["text"] == "True", 1.0).otherwise(0.0)
    return F.coalesce(t["number"], F.when(t["kind"] == "boolean", flag).when(t["kind"] == "string", number), F.lit(0.0))


def int_of(t: Column) -> Column:
    """int() of typed values: numbers cut, booleans, text of whole numbers; 0 otherwise."""
    whole = F.when(t["text"].rlike(r"^[+-]?\d+$"), t["text"].try_cast("bigint"))
    flag = F.when(t["text"] == "True", 1).otherwise(0).cast("bigint")
    return F.coalesce(t["number"].try_cast("bigint"), F.when(t["kind"] == "boolean", flag).when(t["kind"] == "string", whole), F.lit(0).cast("bigint"))


def is_dosage(value: Column) -> Column:
    return value.rlike(r"(?iU)\b(" + "|".join(DOSAGE) + r")\b")


def drop_dosage_values(abnormal: Column) -> Column:
    """A list of variants without the objects whose value speaks of a dosage."""
    spoken = lambda t: F.when(t["kind"].isin("object", "array"), F.to_json(t["v"])).otherwise(text_of(t))
    return F.filter(abnormal, lambda e: fields(e, ["value"], lambda at: ~is_dosage(spoken(at("value")))))


def is_prescription(document_type: Column) -> Column:
    low = F.lower(document_type)
    return F.contains(low, F.lit("prescription")) | (low == "rx")


def clear_prescription_values(results: DataFrame, document_type: str, *lists: str) -> DataFrame:
    """Lists of a prescription become empty."""
    return results.withColumns({c: F.when(is_prescription(F.col(document_type)), F.array().cast(results.schema[c].dataType)).otherwise(F.col(c)) for c in lists})


HEADER = ["disclaimer", "overall_summary", "confidence_score", "urgency_level", "pattern_analysis", "lifestyle_action_plan", "questions_to_ask_doctor", "next_steps", "red_flags", "metadata", "input_summary"]
METADATA, SUMMARY = ["ocr_engine", "llm_provider", "model", "processing_time_sec", "cached"], ["document_type", "detected_language", "detected_hospital", "date_of_report"]
LISTS = ["abnormal_values", "normal_values", "medicines"]
#: All that is asked of a document, as paths of the variant.
PATHS = [*HEADER, *LISTS, *[f"metadata.{n}" for n in METADATA], *[f"input_summary.{n}" for n in SUMMARY]]


def sanitize_header(at: Callable[[str], Column]) -> dict[str, Column]:
    """The fields of a document besides its lists of values and medicines, from the typed values at PATHS."""
    urgency = F.lower(text_of(at("urgency_level")))
    given = lambda p: F.when(~falsy(at(p)), at(p)["v"])
    return {
        "disclaimer": text_of(at("disclaimer")),
        "overall_summary": text_of(at("overall_summary"), NO_SUMMARY),
        "confidence_score": float_of(at("confidence_score")),
        "urgency_level": F.when(urgency.isin(URGENCY), urgency),
        "pattern_analysis": given("pattern_analysis"),
        "lifestyle_action_plan": given("lifestyle_action_plan"),
        **{n: list_of(at(n)) for n in ("questions_to_ask_doctor", "next_steps", "red_flags")},
        "metadata": F.struct(
            int_of(at("metadata.processing_time_sec")).alias("processing_time_sec"),
            *[text_of(at(f"metadata.{n}"), "unknown").alias(n) for n in ("ocr_engine", "llm_provider", "model")],
            (~falsy(at("metadata.cached"))).alias("cached"),
        ),
        "input_summary": F.struct(
            *[text_of(at(f"input_summary.{n}"), "unknown").alias(n) for n in ("document_type", "detected_language")], *[at(f"input_summary.{n}")["v"].alias(n) for n in ("detected_hospital", "date_of_report")]
        ),
    }


def sanitize_test_entries(entries: Column, abnormal: bool) -> Column:
    """Entries as structs with their defaults; normal ones have no severity and no lists. A missing severity is mild, an unknown one unknown."""

    def clean(at: Callable[[str], Column]) -> Column:
        texts = [text_of(at(n), d).alias(n) for n, d in TEST_TEXTS]
        if not abnormal:
            return F.struct(*texts)
        severity = F.lower(text_of(at("severity"), "mild"))
        return F.struct(*texts, F.when(severity.isin(SEVERITY), severity).otherwise("unknown").alias("severity"), *[list_of(at(n)).alias(n) for n in TEST_LISTS])

    paths = [n for n, _ in TEST_TEXTS] + (["severity", *TEST_LISTS] if abnormal else [])
    return F.transform(entries, lambda e: fields(e, paths, clean))


MEDICINE_LISTS = ["common_side_effects", "serious_side_effects", "drug_interactions", "precautions", "lifestyle_tips"]


def sanitize_medicines(entries: Column) -> Column:
    """Twelve fields each; lists are cut to 3; optional texts stay null."""
    names = ["name", "generic_name", "purpose", "mechanism", "how_to_take", *MEDICINE_LISTS[:4], "generic_alternative", MEDICINE_LISTS[4], "cost_saving_tip"]

    def clean(at: Callable[[str], Column]) -> Column:
        def value(n: str) -> Column:
            if n in MEDICINE_LISTS:
                return F.slice(list_of(at(n)), 1, 3)
            return at(n)["v"] if n.startswith("generic") else text_of(at(n), {"name": "Unknown", "purpose": NO_PURPOSE}.get(n))

        return F.struct(*[value(n).alias(n) for n in names])

    return F.transform(entries, lambda m: fields(m, names, clean))


def would_raise(at: Callable[[str], Column]) -> Column:
    """Documents that can't be cleaned field by field: normal values that are null or hold other than objects, metadata or summary of another kind."""
    raw = at("normal_values")
    bad_items = F.exists(list_of(raw), lambda e: ~F.coalesce(F.startswith(F.schema_of_variant(e), F.lit("OBJECT")), F.lit(False)))
    normal = raw["v"].isNotNull() & F.when(raw["kind"] == "array", bad_items).when(raw["kind"].isin("string", "object"), ~falsy(raw)).otherwise(F.lit(True))
    other = [~falsy(at(n)) & (at(n)["kind"] != "object") for n in ("metadata", "input_summary")]
    return F.coalesce(reduce(lambda a, b: a | b, other, normal), F.lit(False))


#: Types of the clean lists, for a document that has none.
_NORMAL = "test_name string, value string, normal_range string, what_it_means string"
_CLEAN_LISTS = {
    "abnormal_values": f"array<struct<{_NORMAL}, severity string, {', '.join(f'{n} array<variant>' for n in TEST_LISTS)}>>",
    "normal_values": f"array<struct<{_NORMAL}>>",
    "medicines": "array<struct<name string, generic_name variant, purpose string, mechanism string, how_to_take string, " + ", ".join(f"{n} array<variant>" for n in MEDICINE_LISTS[:4]) + ", generic_alternative variant, lifestyle_tips array<variant>, cost_saving_tip string>>",
}


def empty_document(**given: Column) -> Column:
    """The document of all defaults, but for the fields that are given."""
    none = F.lit(None).cast("struct<kind string, text string, number double, v variant>")
    return F.struct(*[given.get(n, c).alias(n) for n, c in (sanitize_header(lambda p: none) | {n: F.array().cast(t) for n, t in _CLEAN_LISTS.items()}).items()])


def sanitize_column(raw: Column) -> Column:
    """A clean document struct from a variant: header, prescriptions, dosages, entries, medicines, in this order.

    What isn't an object, or can't be cleaned, becomes the document of all defaults, as a row and not an error. The
    values at PATHS are typed first, by one expression; all fields follow from these.
    """
    place = {p: i for i, p in enumerate(PATHS)}

    def clean(t: Column) -> Column:
        at = lambda p: F.get(t, F.lit(place[p]))
        none = F.array().cast("array<variant>")
        rx = is_prescription(text_of(at("input_summary.document_type"), "unknown"))
        values = lambda n: F.when(rx, none).otherwise(list_of(at(n)))
        lists = {
            "abnormal_values": sanitize_test_entries(drop_dosage_values(values("abnormal_values")), True),
            "normal_values": sanitize_test_entries(values("normal_values"), False),
            "medicines": sanitize_medicines(list_of(at("medicines"))),
        }
        return F.struct(*[c.alias(n) for n, c in (sanitize_header(at) | lists).items()])

    def whole(t: Column) -> Column:
        return F.when(~would_raise(lambda p: F.get(t, F.lit(place[p]))), t)

    paths = let(raw, lambda v: F.transform(F.array(*[field(v, p) for p in PATHS]), typed))
    return let(let(paths, whole), clean)


def sanitize_results(results: DataFrame, raw: str = "raw", out: str = "doc") -> DataFrame:
    """Adds a clean document for each raw JSON text or variant; text that doesn't parse counts as no document."""
    v = F.try_parse_json(F.col(raw)) if dict(results.dtypes)[raw] == "string" else F.col(raw)
    return results.withColumn("__v", v).withColumn(out, sanitize_column(F.col("__v"))).drop("__v")


def conforms(doc: Column) -> Column:
    """Whether a clean document also has the schema's types in its free places: texts in lists, objects or null elsewhere."""
    text = lambda e: F.coalesce(F.schema_of_variant(e) == "STRING", F.lit(False))
    texts = lambda a, names: F.forall(F.concat(*[a[n] for n in names]), text)
    optional = lambda v, k: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(k)) | (F.schema_of_variant(v) == "VOID"), F.lit(True))
    tests = F.forall(doc["abnormal_values"], lambda e: texts(e, TEST_LISTS))
    meds = F.forall(doc["medicines"], lambda m: texts(m, MEDICINE_LISTS) & optional(m["generic_name"], "STRING") & optional(m["generic_alternative"], "STRING"))
    top = texts(doc, ["questions_to_ask_doctor", "next_steps", "red_flags"])
    free = optional(doc["pattern_analysis"], "OBJECT") & optional(doc["lifestyle_action_plan"], "OBJECT")
    summary = optional(doc["input_summary"]["detected_hospital"], "STRING") & optional(doc["input_summary"]["date_of_report"], "STRING")
    return tests & meds & top & free & summary


def conform_results(results: DataFrame, doc: str = "doc", cached: bool = False) -> DataFrame:
    """Replaces a document that fails the schema by a minimal safe one: the cached form says so, the stored one keeps summary and confidence."""
    d = F.col(doc)
    ok = F.coalesce(conforms(d), F.lit(False))
    if cached:
        safe = empty_document(overall_summary=F.lit("Result temporarily unavailable")).withField("metadata.cached", F.lit(True))
    else:
        safe = empty_document(**{n: d[n] for n in ("disclaimer", "overall_summary", "confidence_score", "metadata")})
    return results.withColumn("conforms", ok).withColumn(doc, F.when(ok, d).otherwise(safe))
