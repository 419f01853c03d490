"""A query for each operator over the driver tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.functions import text as fx
from assayflow.operators import catalog, extract, jobs, knowledge, report, responses, sanitize, vectors
from assayflow.plans import bindings as b
from assayflow.sources import codes, files, versions
from assayflow.streaming import limits, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW, M, C, J, L = b.NOW, b.MEASUREMENTS_SQL, b.CATALOG_SQL, b.JOBS_SQL, b.CODES_SQL


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


# Sources, triage, sinks


@query("""
SELECT doc_id, CASE WHEN ext NOT IN ('.pdf', '.png', '.jpg') THEN 'extension' WHEN mime = 'text/csv' THEN 'mime' WHEN length > 2000 THEN 'size' WHEN bad THEN 'content' END AS reason,
  CASE WHEN ext IN ('.pdf', '.png', '.jpg') AND mime <> 'text/csv' AND length <= 2000 AND NOT bad THEN 202 WHEN ext IN ('.pdf', '.png', '.jpg') AND mime <> 'text/csv' AND length > 2000 THEN 413 ELSE 400 END AS http_code
FROM (SELECT doc_id, ['.pdf', '.csv', '.png', '.jpg'][doc_id % 4 + 1] AS ext, CASE WHEN doc_id % 11 = 0 THEN 'text/csv' ELSE 'application/pdf' END AS mime,
  strlen(text) + 4 AS length, doc_id % 4 = 2 OR (doc_id % 4 = 3) OR (doc_id % 4 = 0 AND doc_id % 7 = 0) AS bad FROM documents)
""")
def triage_uploads(spark: SparkSession, d: str) -> DataFrame:
    docs = b.table(spark, d, "documents").where(F.col("text").isNotNull())
    ext = F.element_at(F.array(*[F.lit(e) for e in (".PDF", ".csv", ".png", ".jpg")]), (F.col("doc_id") % 4 + 1).cast("int"))
    uploads = docs.select(
        "doc_id", F.concat(F.lit("in/"), F.col("doc_id").cast("string"), ext).alias("path"), F.when(F.col("doc_id") % 11 == 0, "text/csv").otherwise("application/pdf").alias("mime"),
        F.concat(F.when(F.col("doc_id") % 7 == 0, "none").otherwise("%PDF"), "text").cast("binary").alias("content"),
    ).withColumn("length", F.octet_length("content"))
    return files.triage_uploads(uploads, 2000).select("doc_id", "reason", "http_code")


@query("""
SELECT 'job_' || h AS id, 'uploads/job_' || h || '.pdf' AS file_path, 'queued' AS status, 'uploading' AS stage, 5 AS progress FROM (
SELECT md5('in/' || event_id || '.PDF|' || strftime(ts, '%Y-%m-%d %H:%M:%S')) AS h FROM events)
""")
def new_jobs(spark: SparkSession, d: str) -> DataFrame:
    accepted = b.table(spark, d, "events").select(F.concat(F.lit("in/"), F.col("event_id").cast("string"), F.lit(".PDF")).alias("path"), F.col("ts").alias("modificationTime"))
    return files.new_jobs(accepted, NOW).select("id", "file_path", "status", "stage", "progress")


PAGES_SQL = """
SELECT conv_id AS doc_id, turn AS page_no, CASE WHEN role = 'user' THEN 'ocr' ELSE 'native' END AS method, text FROM conversations
"""
DOC_TEXT_SQL = f"""
SELECT doc_id, coalesce(nullif(regexp_replace(n, '^\\s+|\\s+$', '', 'g'), ''), regexp_replace(o, '^\\s+|\\s+$', '', 'g')) AS text FROM (
SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY page_no, text) FILTER (method = 'native' AND NOT regexp_matches(text, '^\\s*$')), '') AS n,
  coalesce(string_agg(text, chr(10) ORDER BY page_no, text) FILTER (method = 'ocr' AND NOT regexp_matches(text, '^\\s*$')), '') AS o FROM ({PAGES_SQL}) GROUP BY doc_id)
"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.when(F.col("role") == "user", "ocr").otherwise("native").alias("method"), "text")


@query(DOC_TEXT_SQL)
def assemble_document_text(spark: SparkSession, d: str) -> DataFrame:
    return files.assemble_document_text(pages(spark, d))


@query("SELECT conv_id * 1000 + turn AS doc_id, 'failed' AS status, 'OCR returned empty text' AS error_message FROM conversations WHERE conv_id % 3 = 0 OR text IS NULL OR trim(text) = ''")
def quarantine_empty_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("conv_id") % 3 == 0, " \n\t").otherwise(F.col("text"))
    docs = b.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), text.alias("text"))
    return files.quarantine_empty_text(docs)[1].select("doc_id", "status", "error_message")


@query(f"SELECT id, display_name, category, aliases, CAST(normal_min AS VARCHAR) AS normal_min FROM ({C})")
def read_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The entries, and metadata beside them, as JSON files in the shared folder: one for each first letter, read back."""
    own = b.lab_catalog(spark, d)
    entry = F.struct("display_name", "category", "aliases", F.col("normal_min").cast("string").alias("normal_min"))
    both = own.select("id", entry.alias("entry"), F.substring("id", 1, 1).alias("letter"))
    both = both.unionByName(both.withColumn("id", F.concat(F.lit("_"), "id")))
    path = b_path(spark, "catalog-files")
    both.groupBy("letter").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "entry")))).alias("value")).write.partitionBy("letter").text(path)
    return files.read_catalog(spark, f"{path}/letter=*").select("id", "entry.display_name", "entry.category", "entry.aliases", "entry.normal_min")


@query(f'SELECT row_no, component AS "COMPONENT", status AS "STATUS" FROM ({L})')
def read_lab_codes(spark: SparkSession, d: str) -> DataFrame:
    """The code list written as CSV in the shared folder, and read with its rules: empty columns are ''."""
    path = b_path(spark, "codes")
    b.lab_codes(spark, d).withColumn("row_id", F.col("row_no")).drop("row_no").write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    return codes.read_lab_codes(spark, path).select(F.col("row_id").cast("long").alias("row_no"), "COMPONENT", "STATUS")


def b_path(spark: SparkSession, name: str) -> str:
    from assayflow.sources.shared import shared_path

    return shared_path(spark, name)


@query(f"SELECT id, category FROM ({C})")
def write_catalog(spark: SparkSession, d: str) -> DataFrame:
    path = b_path(spark, "catalog")
    files.write_catalog(b.lab_catalog(spark, d).select("id", "category", "ord"), path, ordered_by="ord")
    return spark.read.schema("id string, category string").json(path)


@query("SELECT conv_id * 1000 + turn AS job_id, 0.0::DOUBLE AS confidence, length(text) AS n, false AS cached FROM conversations WHERE role = 'assistant' AND text IS NOT NULL")
def store_results(spark: SparkSession, d: str) -> DataFrame:
    t = b.table(spark, d, "conversations").where((F.col("role") == "assistant") & F.col("text").isNotNull())
    doc = F.struct(F.col("text").alias("overall_summary"), F.lit(None).cast("double").alias("confidence_score"))
    path = b_path(spark, "results")
    rows = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), doc.alias("doc"), F.lit(3).alias("processing_time"), F.lit("p").alias("llm_provider"), F.lit("m").alias("model"))
    for batch in (0, 1, 0):  # the first one is tried again
        files.store_results(rows.where(F.pmod("job_id", F.lit(2)) == batch), path, NOW, batch)
    back = versions.read_batches(spark, path)
    return back.select("job_id", "confidence", F.length(F.get_json_object("result_json", "$.overall_summary")).cast("long").alias("n"), "cached")


# Scalar functions, as projections of whole tables


@query(r"SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", fx.normalize_text(F.col("text")).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_totalprice END AS value FROM orders")
def parse_number(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    plain = F.col("o_totalprice").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.regexp_replace(plain, r"(\d)(?=\d{3}\.)", "$1,"))).when(F.col("o_orderkey") % 3 == 1, plain).otherwise(F.concat(plain, F.lit(" abc")))
    return o.select("o_orderkey", fx.parse_number(text).alias("value"))


@query(f"SELECT row_no, CASE WHEN lower(unit) = 'mg/dl' THEN 'mg/dL' ELSE lower(unit) END AS unit_normalized FROM ({L})")
def normalize_unit(spark: SparkSession, d: str) -> DataFrame:
    return fx.normalize_unit(b.lab_codes(spark, d).select("row_no", "unit"), b.units(spark)).select("row_no", "unit_normalized")


@query(f"""
WITH c AS ({C}), f AS (SELECT aliases[1] AS alias, arg_min(id, ord) AS id FROM c GROUP BY 1)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN f.id WHEN 2 THEN 'syn_' || split_part(p_name, ' ', 1) END AS entity_id
FROM part LEFT JOIN f ON f.alias = split_part(p_name, ' ', 2)
""")
def resolve_name(spark: SparkSession, d: str) -> DataFrame:
    p, c = b.table(spark, d, "part"), b.lab_catalog(spark, d)
    first = F.split("p_name", " ")[0]
    name = F.when(F.col("p_partkey") % 4 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(" "), F.split("p_name", " ")[1])).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("s "), first)).otherwise("none")
    synonyms = p.select(F.concat(F.lit("s "), first).alias("alias"), F.concat(F.lit("syn_"), first).alias("id")).distinct()
    aliases = c.select("id", "ord", F.explode("aliases").alias("alias"))
    return fx.resolve_name(p.select("p_partkey", name.alias("name")), synonyms, aliases).select("p_partkey", "entity_id")


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS lab_key,
  replace(replace(lower(p_name || ' / ' || p_brand), ' ', '_'), '/', '_') AS drug_key FROM part
""")
def entity_key(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part")
    lab, drug = F.concat("p_name", F.lit(" / ("), "p_brand", F.lit(")")), F.concat("p_name", F.lit(" / "), "p_brand")
    return p.select("p_partkey", fx.entity_key(lab).alias("lab_key"), fx.entity_key(drug, drug=True).alias("drug_key"))


@query("SELECT doc_id, md5(text) AS content_id FROM documents")
def content_id(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", fx.content_id(F.col("text")).alias("content_id"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 300 AND strpos(substr(text, 41), '.') > 0 THEN substr(text, 1, 40 + strpos(substr(text, 41), '.')) ELSE text END AS text FROM documents
""")
def truncate_indication(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", fx.truncate_indication(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN regexp_replace(substr(text, 1, 200), ' [^ ]*$', '', 's') || '...' ELSE text END AS text FROM documents")
def truncate_words(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", fx.truncate_words(F.col("text")).alias("text"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '-') AS name FROM part")
def title_case(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "part").select("p_partkey", fx.title_case(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"))


RESPONSES = "SELECT conv_id * 1000 + turn AS job_id, conv_id, turn, text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL"


@query(f"SELECT job_id, ['whole', 'fence', 'braces', NULL][conv_id % 4 + 1] AS repair_stage, CASE WHEN conv_id % 4 = 3 THEN 'truncated' END AS error, CASE WHEN conv_id % 4 <> 3 THEN text END AS summary FROM ({RESPONSES})")
def repair_json(spark: SparkSession, d: str) -> DataFrame:
    return responses.repair_json(b.responses(spark, d)).select("job_id", "repair_stage", "error", F.try_variant_get("doc", "$.overall_summary", "string").alias("summary"))


@query(f"SELECT job_id, CASE WHEN conv_id % 4 = 3 THEN 'missing key: disclaimer' ELSE 'confidence_score must be a number' END AS schema_error FROM ({RESPONSES})")
def require_keys(spark: SparkSession, d: str) -> DataFrame:
    return responses.require_keys(responses.repair_json(b.responses(spark, d))).select("job_id", "schema_error")


# Filters

_RELEVANT = f"SELECT * FROM ({L}) WHERE STATUS IN ('ACTIVE', '') AND SYSTEM IN ('Ser/Plas', 'Urine', 'Bld') AND PROPERTY IN ('MCnc', '') AND SCALE_TYP IN ('Qn', '') AND trim(COMPONENT) <> ''"
_PRIORITY = "(" + " OR ".join(f"contains(lower(COMPONENT), '{p}')" for p in catalog.PRIORITY) + ")"


@query(f'SELECT row_no, COMPONENT AS "COMPONENT" FROM ({_RELEVANT})')
def filter_lab_codes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.filter_lab_codes(b.lab_codes(spark, d)).select("row_no", "COMPONENT")


@query(r"""
SELECT job_id, CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END AS kept FROM (SELECT conv_id * 1000 + turn AS job_id, * FROM conversations WHERE role = 'assistant' AND text IS NOT NULL) WHERE conv_id % 4 <> 3
""")
def drop_dosage_values(spark: SparkSession, d: str) -> DataFrame:
    r = responses.repair_json(b.responses(spark, d)).where(F.col("error").isNull())
    kept = sanitize.drop_dosage_values(sanitize.ensure_list(sanitize.field(F.col("doc"), "abnormal_values")))
    return r.select("job_id", F.size(kept).alias("kept"))


@query("SELECT doc_id, CASE WHEN source = 'src1' OR source LIKE 'src1_%' OR source = 'src5' THEN [] ELSE [n_chars] END AS vals FROM documents")
def clear_prescription_values(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.startswith("source", F.lit("src1")), "My Prescription").when(F.col("source") == "src5", "RX").otherwise("lab")
    docs = b.table(spark, d, "documents").select("doc_id", kind.alias("kind"), F.array("n_chars").alias("vals"))
    return sanitize.clear_prescription_values(docs, "kind", "vals").select("doc_id", "vals")


@query("SELECT p_partkey FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size = 1)")
def class_filter(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").withColumn("category", F.col("p_type"))
    return catalog.class_filter(p, p.where(F.col("p_size") == 1).select("category")).select("p_partkey")


# Joins

_TEXT_SQL = f"SELECT doc_id, string_agg(name || ': ' || value || ' mg/dl', ' ' ORDER BY pos, name, value) AS text FROM ({M}) GROUP BY doc_id"
_HITS_SQL = f"""
SELECT m.doc_id, c.id, c.display_name AS name, m.value, 'mg/dL' AS unit, nullif(c.normal_min, -1) AS normal_min, c.normal_max, 0 AS alias_ord FROM ({M}) m JOIN ({C}) c ON suffix(m.name, c.display_name)
UNION ALL
SELECT m.doc_id, c.id, c.display_name, m.value, 'mg/dL', c.normal_min, c.normal_max, 1 FROM ({M}) m JOIN ({C}) c ON suffix(m.name, c.aliases[1])
"""


@query(_HITS_SQL)
def extract_measurements(spark: SparkSession, d: str) -> DataFrame:
    found = extract.extract_measurements(b.report_text(spark, d), b.lab_catalog(spark, d), b.units(spark))
    return found.select("doc_id", "id", "name", "value", "unit", "normal_min", "normal_max", "alias_ord")


_NAMES = " UNION ALL ".join(f"SELECT '{k}' AS id, '{c}' AS category, {i} AS ord, '{t}' AS token" for i, (k, c, a) in enumerate(b.MEDICINES) for t in [k, *[x.lower() for x in a]])
_ENTITIES = f"""
SELECT doc_id, id, any_value(category) AS category, min(pos) AS first_pos, min(ord) AS ord FROM (
  SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_\\-]+'), lambda t: regexp_full_match(t, '[a-z0-9\\-]{{4,}}')) AS w FROM documents)
) JOIN ({_NAMES}) n USING (token) GROUP BY doc_id, id
"""


@query(f"SELECT doc_id, id, category FROM ({_ENTITIES})")
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_entities(b.table(spark, d, "documents").select("doc_id", "text"), b.medicine_catalog(spark)).select("doc_id", "id", "category")


_RANGE_CASE = lambda k: "CASE " + " ".join(f"WHEN contains(lower(COMPONENT), '{r[0]}') THEN " + (f"CAST({r[k]} AS DOUBLE)" if k < 3 else f"'{r[k]}'") for r in catalog.REFERENCE_RANGES) + " END"


@query(f"SELECT row_no, {_RANGE_CASE(1)} AS normal_min, {_RANGE_CASE(2)} AS normal_max, coalesce({_RANGE_CASE(3)}, unit) AS unit FROM ({L})")
def attach_reference_ranges(spark: SparkSession, d: str) -> DataFrame:
    return catalog.attach_reference_ranges(b.lab_codes(spark, d)).select("row_no", "normal_min", "normal_max", "unit")


_CLASSIFIED = f"""
SELECT *, value < normal_min OR value > normal_max AS is_abnormal, CASE WHEN value < normal_min THEN 'low' WHEN value > normal_max THEN 'high' END AS direction,
  CASE WHEN NOT (value < normal_min OR value > normal_max) THEN 'unknown' WHEN dev > 50 THEN 'critical' WHEN dev > 30 THEN 'severe' WHEN dev > 15 THEN 'moderate' ELSE 'mild' END AS severity
FROM (SELECT *, CASE WHEN value < normal_min THEN (normal_min - value) / normal_min * 100 WHEN value > normal_max THEN (value - normal_max) / normal_max * 100 ELSE 0 END AS dev FROM ({M}))
"""
_ENRICHED = f"""
SELECT m.*, value || ' mg/dl' AS value_str, normal_min || '–' || normal_max || ' mg/dl' AS normal_range_str,
  CASE WHEN is_abnormal THEN coalesce(CASE WHEN name LIKE 'b%' THEN 'About ' || name END, 'This value is outside the normal range (' || CASE direction WHEN 'low' THEN 'below' ELSE 'above' END || ' normal).')
  ELSE 'This value is within the normal range.' END AS meaning,
  CASE WHEN is_abnormal THEN ['What is causing my ' || direction || ' ' || name || ' result?', 'Is my ' || name || ' level serious at this range?', 'Do I need further tests for ' || name || '?',
    'What lifestyle changes can help improve my ' || name || '?'] ELSE [] END AS questions FROM ({_CLASSIFIED}) m
"""


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return report.enrich_measurements(b.measurements(spark, d), b.lab_catalog(spark, d))


@query(f"SELECT doc_id, pos, name, value_str, normal_range_str, severity, meaning, questions FROM ({_ENRICHED})")
def enrich_measurements(spark: SparkSession, d: str) -> DataFrame:
    return enriched(spark, d).select("doc_id", "pos", "name", "value_str", "normal_range_str", "severity", "meaning", "questions")


@query("""
SELECT user_id AS doc_id, event_id, CASE WHEN event_id % 6 < 5 THEN ['That', 'Nicht', 'Dans', 'Para', 'Tion'][event_id % 6 + 1] ELSE 'other' END AS name,
  CASE WHEN event_id % 6 < 5 THEN 'Helps with ' || ['A', 'B', 'C', 'D', 'E'][event_id % 6 + 1] ELSE 'Prescribed by your doctor.' END AS purpose, 0 AS n_tips FROM events
""")
def enrich_medicines(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array(*[F.lit(x) for x in ("that", "nicht", "dans", "para", "tion", "other")])
    meds = b.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), "event_id", F.element_at(ids, (F.col("event_id") % 6 + 1).cast("int")).alias("id")).withColumn("name", F.col("id"))
    return report.enrich_medicines(meds, b.medicine_catalog(spark)).select("doc_id", "event_id", "name", "purpose", F.size("lifestyle_tips").alias("n_tips"))


@query(f"WITH c AS ({C}) SELECT id, category FROM c WHERE ord % 2 = 0 UNION ALL SELECT id, 'new' FROM c WHERE ord % 2 = 1")
def merge_catalog(spark: SparkSession, d: str) -> DataFrame:
    c = b.lab_catalog(spark, d).select("id", "category", "ord")
    return catalog.merge_catalog(c.where(F.col("ord") % 2 == 0), c.withColumn("category", F.lit("new"))).select("id", "category")


_UPSERTED = """
WITH n AS (SELECT vec_id % 40 AS e, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'k' || vec_id % 2 END AS t, max(vec_id) AS v FROM embeddings WHERE vec_id % 4 = 0 GROUP BY 1, 2)
SELECT 'chunk ' || v AS content, 'e' || e AS entity_id, t AS chunk_type FROM n
UNION ALL SELECT 'old ' || vec_id, 'e' || vec_id % 50, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'k' || vec_id % 2 END FROM embeddings x
WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.e = x.vec_id % 50 AND n.t IS NOT DISTINCT FROM CASE WHEN x.vec_id % 3 = 0 THEN NULL ELSE 'k' || x.vec_id % 2 END)
"""


def knowledge_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = b.table(spark, d, "embeddings")
    kind = F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("k"), (F.col("vec_id") % 2).cast("string")))
    row = lambda label, n: [F.concat(F.lit(label), F.col("vec_id").cast("string")).alias("content"), "embedding", F.lit("s").alias("source"), F.concat(F.lit("e"), (F.col("vec_id") % n).cast("string")).alias("entity_id"), kind.alias("chunk_type")]
    target = e.select(*row("old ", 50), F.lit("{}").alias("metadata"))
    chunks = e.where(F.col("vec_id") % 4 == 0).select(*row("chunk ", 40), F.col("vec_id").alias("ord"))
    return target, chunks


@query(_UPSERTED)
def upsert_knowledge(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.upsert_knowledge(*knowledge_rows(spark, d)).select("content", "entity_id", "chunk_type")


@query(_UPSERTED)
def store_knowledge(spark: SparkSession, d: str) -> DataFrame:
    """The same as versions of a stored table: what was there, then the chunks in two commits, the second of them twice."""
    path = b_path(spark, "knowledge")
    target, chunks = knowledge_rows(spark, d)
    versions.upsert_version(path, target, knowledge.KEY, lambda old, new: new, "first")
    for part in (0, 1, 1):
        knowledge.store_knowledge(path, chunks.where(F.pmod(F.xxhash64(*knowledge.KEY), F.lit(2)) == part), part)
    return versions.read_version(spark, path).select("content", "entity_id", "chunk_type")


_REQUESTS = "SELECT event_id AS request_id, event_id % 20000 AS job_id FROM events"


def job_requests(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") % 20000).alias("job_id"))


@query(f"""
SELECT request_id, job_id, CASE WHEN id IS NULL THEN 404 WHEN status = 'expired' THEN 410 ELSE 200 END AS http_code, CASE WHEN status <> 'expired' THEN status END AS status,
  CASE WHEN status <> 'expired' THEN progress END AS progress FROM ({_REQUESTS}) LEFT JOIN ({J}) j ON id = job_id
""")
def job_status(spark: SparkSession, d: str) -> DataFrame:
    return jobs.job_status(job_requests(spark, d), b.jobs(spark, d)).select("request_id", "job_id", "http_code", "status", "progress")


@query(f"""
WITH j AS ({J}), s AS (SELECT request_id, job_id, id, status, error_message, CASE WHEN job_id % 3 = 0 AND job_id % 2 = 0 THEN 'cached ' || job_id WHEN job_id % 5 <> 0 THEN 'stored ' || job_id END AS doc FROM ({_REQUESTS}) LEFT JOIN j ON id = job_id)
SELECT request_id, job_id, http_code, CASE http_code WHEN 404 THEN 'Job not found' WHEN 410 THEN 'This job has expired and is no longer available' WHEN 400 THEN 'Job processing failed: ' || coalesce(error_message, 'Unknown error')
  WHEN 202 THEN 'Job not completed yet (current status: ' || status || ')' WHEN 500 THEN 'Result not found for completed job' END AS message,
  CASE WHEN http_code = 200 THEN CASE WHEN doc LIKE 'cached%' THEN 'cache' ELSE 'store' END END AS served_from, CASE WHEN http_code = 200 THEN doc END AS doc
FROM (SELECT *, CASE WHEN id IS NULL THEN 404 WHEN status = 'expired' THEN 410 WHEN status = 'failed' THEN 400 WHEN status <> 'completed' THEN 202 WHEN doc IS NOT NULL THEN 200 ELSE 500 END AS http_code FROM s)
""")
def serve_results(spark: SparkSession, d: str) -> DataFrame:
    j = b.jobs(spark, d)
    written = F.when(F.col("id") % 2 == 0, F.lit(NOW).cast("timestamp")).otherwise(F.timestamp_add("HOUR", F.lit(-2), F.lit(NOW).cast("timestamp")))
    cache = j.where(F.col("id") % 3 == 0).select(F.col("id").alias("job_id"), F.concat(F.lit("cached "), F.col("id").cast("string")).alias("doc"), written.alias("written_at"), F.lit(3600).alias("ttl_sec"))
    rows = j.where(F.col("id") % 5 != 0).select("id", F.col("id").alias("job_id"), F.concat(F.lit("stored "), F.col("id").cast("string")).alias("result_json"))
    return jobs.serve_results(job_requests(spark, d), j, cache, rows, NOW)


# Aggregations, dedupe, counts

_KEY = "regexp_replace(regexp_replace(lower(COMPONENT), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""
WITH r AS (SELECT {_KEY} AS key, *, {_PRIORITY} AS p FROM ({_RELEVANT})), k AS (SELECT key, min(row_no) FILTER (NOT p) AS cut FROM r GROUP BY key),
e AS (SELECT key, min(row_no) AS pos, max(row_no) AS used FROM r JOIN k USING (key) WHERE p AND (cut IS NULL OR row_no < cut) GROUP BY key),
o AS (SELECT key, min(row_no) AS pos FROM r WHERE NOT p GROUP BY key), n AS (SELECT (SELECT count(*) FROM e) AS np, (SELECT count(*) FROM o) AS no),
q AS (SELECT key, pos, row_number() OVER (ORDER BY pos) AS i FROM o)
SELECT key, pos, true AS is_priority, used AS row_no FROM e UNION ALL
SELECT key, pos, false, pos FROM q, n WHERE i <= CASE WHEN 60 - np >= 0 THEN 60 - np ELSE greatest(no + 60 - np, 0) END AND key NOT IN (SELECT key FROM e)
""")
def resolve_lab_catalog(spark: SparkSession, d: str) -> DataFrame:
    codes = catalog.filter_lab_codes(b.lab_codes(spark, d)).withColumn("key", fx.entity_key(F.col("COMPONENT")))
    return catalog.resolve_lab_catalog(codes.select("key", "row_no", "COMPONENT"), 60).select("key", "pos", "is_priority", "row_no")


def members(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "part").select((F.col("p_size") % 7).cast("long").alias("class_ord"), F.concat(F.lit("c"), (F.col("p_size") % 7).cast("string")).alias("category"), F.col("p_partkey").alias("member_ord"), F.col("p_name").alias("name"))


_BRANDS_SQL = "SELECT p_name AS drug, min(p_brand) AS brand FROM part GROUP BY 1"


def brands(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part")
    one = p.groupBy(F.col("p_name").alias("drug")).agg(F.min("p_brand").alias("brand"))
    return catalog.merge_brands(one.withColumn("ord", F.lit(0)), one.select("drug", F.upper("brand").alias("brand"), F.lit(0).alias("ord")).unionByName(one.select("drug", F.concat(F.lit("x"), "brand").alias("brand"), F.lit(1).alias("ord"))), one.select("drug"))


@query(f"SELECT drug, [brand, 'x' || brand, drug] AS aliases FROM ({_BRANDS_SQL})")
def merge_brands(spark: SparkSession, d: str) -> DataFrame:
    return brands(spark, d)


@query(f"""
SELECT replace(name, ' ', '_') AS id, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS display_name, 'c' || class AS category,
  [brand, 'x' || brand, drug] AS aliases, CASE WHEN name LIKE 'b%' THEN 'for ' || name END AS purpose
FROM (SELECT p_name AS name, arg_min(p_size % 7, (p_size % 7) * 10000000 + p_partkey) AS class FROM part GROUP BY 1) JOIN ({_BRANDS_SQL}) ON drug = name
""")
def build_drug_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part")
    indications = p.where(F.startswith("p_name", F.lit("b"))).select(F.col("p_name").alias("name"), F.concat(F.lit("for "), "p_name").alias("indication")).distinct()
    return catalog.build_drug_catalog(members(spark, d), brands(spark, d), indications)


@query("SELECT count(DISTINCT p_name) AS unique_keys, count(*) - count(DISTINCT p_name) AS duplicates_skipped FROM part")
def drug_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.drug_counts(members(spark, d))


@query(f"""
SELECT doc_id, count(*) FILTER (is_abnormal) AS abnormal, count(*) FILTER (NOT is_abnormal) AS normal,
  max(CASE WHEN is_abnormal THEN CASE severity WHEN 'mild' THEN 1 WHEN 'moderate' THEN 2 WHEN 'severe' THEN 3 ELSE 4 END ELSE 0 END) AS worst FROM ({_CLASSIFIED}) GROUP BY doc_id
""")
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.report_counts(report.classify_severity(b.measurements(spark, d)))


@query(f"""
SELECT count(*) FILTER (created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND status IN ('completed', 'failed')) AS expired_jobs,
  count(*) FILTER (created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND file_path <> '') AS deleted_files,
  count(*) FILTER (status = 'expired' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS purged_jobs FROM ({J})
""")
def cleanup_summary(spark: SparkSession, d: str) -> DataFrame:
    return jobs.cleanup_summary(b.jobs(spark, d), NOW)


@query(f"""
SELECT (SELECT count(*) FROM ({L})) AS rows_read, count(*) AS relevant, count(*) FILTER ({_PRIORITY}) AS priority, count(*) FILTER (NOT {_PRIORITY}) AS other,
  (SELECT count(DISTINCT p_name) FROM part) AS final FROM ({_RELEVANT})
""")
def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog_stats(b.lab_codes(spark, d), b.lab_catalog(spark, d))


# Classification


@query(f"SELECT doc_id, pos, id, value, is_abnormal, direction, severity, CAST(dev AS DOUBLE) AS deviation FROM ({_CLASSIFIED})")
def classify_severity(spark: SparkSession, d: str) -> DataFrame:
    return report.classify_severity(b.measurements(spark, d)).select("doc_id", "pos", "id", "value", "is_abnormal", "direction", "severity", "deviation")


_CATEGORY = "CASE WHEN contains(lower(SYSTEM), 'urine') OR lower(SYSTEM) = 'ur' THEN 'urine' " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(COMPONENT), '{w}')" for w in words) + f" THEN '{name}'" for name, words in catalog.CATEGORIES
) + " ELSE 'other' END"


@query(f"SELECT row_no, {_CATEGORY} AS category FROM ({L})")
def infer_category(spark: SparkSession, d: str) -> DataFrame:
    return b.lab_codes(spark, d).select("row_no", catalog.infer_category(F.col("COMPONENT"), F.col("SYSTEM")).alias("category"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR length(text) > 500 OR doc_id % 2 = 0 THEN 'heavy' ELSE 'light' END AS model, CASE WHEN doc_id % 3 = 0 OR length(text) > 500 OR doc_id % 2 = 0 THEN 4096 ELSE 2048 END AS max_tokens FROM documents")
def choose_model(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    docs = b.table(spark, d, "documents").select("doc_id", F.col("text").alias("raw_text"), some(F.col("doc_id") % 3 == 0).alias("tests"), some(F.col("doc_id") % 2 == 1).alias("medicines"))
    return responses.choose_model(docs).select("doc_id", "model", "max_tokens")


# Job tables


@query(f"""
SELECT id, CASE WHEN x THEN 'expired' ELSE status END AS status, CASE WHEN x THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at
FROM (SELECT *, created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND status IN ('completed', 'failed') AS x FROM ({J}))
""")
def mark_expired(spark: SparkSession, d: str) -> DataFrame:
    return jobs.mark_expired(b.jobs(spark, d), NOW).select("id", "status", "updated_at")


@query(f"SELECT id, file_path FROM ({J}) WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND file_path <> ''")
def files_to_delete(spark: SparkSession, d: str) -> DataFrame:
    return jobs.files_to_delete(b.jobs(spark, d), NOW)


_PURGE = f"status = 'expired' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY"


@query(f"WITH j AS ({J}) SELECT 'job' AS kind, id FROM j WHERE NOT ({_PURGE}) UNION ALL SELECT 'result', id FROM j WHERE NOT ({_PURGE}) AND id % 3 = 0")
def purge_expired(spark: SparkSession, d: str) -> DataFrame:
    j = b.jobs(spark, d)
    left, results = jobs.purge_expired(j, j.where(F.col("id") % 3 == 0).select(F.col("id").alias("job_id")), NOW)
    return left.select(F.lit("job").alias("kind"), "id").unionByName(results.select(F.lit("result").alias("kind"), F.col("job_id").alias("id")))


@query(f"""
SELECT id, CASE WHEN x THEN 'queued' ELSE status END AS status, CASE WHEN x THEN 'uploading' ELSE stage END AS stage, CASE WHEN x THEN 0 ELSE progress END AS progress, x AS recovered
FROM (SELECT *, status = 'processing' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AS x FROM ({J}))
""")
def recover_stuck(spark: SparkSession, d: str) -> DataFrame:
    return jobs.recover_stuck(b.jobs(spark, d), NOW).select("id", "status", "stage", "progress", "recovered")


@query(f"SELECT id FROM ({J}) WHERE status = 'queued' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 60 SECOND")
def find_orphans(spark: SparkSession, d: str) -> DataFrame:
    return jobs.find_orphans(b.jobs(spark, d), NOW)


_LAST = f"""
SELECT job_id, arg_max(status, ts) AS status, arg_max(stage, ts) AS stage, arg_max(error, ts) FILTER (error IS NOT NULL) AS error, max(ts) AS updated_at FROM ({b.JOB_EVENTS_SQL}) GROUP BY job_id
"""
_PROGRESS = "CASE {c} WHEN 'extracting_text' THEN 25 WHEN 'parsing' THEN 45 WHEN 'finalizing' THEN 90 WHEN 'done' THEN 100 END"


@query(f"""
SELECT id, coalesce(e.status, j.status) AS status, coalesce(e.stage, j.stage) AS stage, coalesce({_PROGRESS.format(c="e.stage")}, progress) AS progress, coalesce(e.error, error_message) AS error_message,
  coalesce(e.updated_at, j.updated_at) AS updated_at FROM ({J}) j LEFT JOIN ({_LAST}) e ON id = job_id
""")
def advance_stage(spark: SparkSession, d: str) -> DataFrame:
    events = b.job_events(spark, d).withColumnRenamed("job_id", "id")
    return jobs.advance_stage(b.jobs(spark, d), events).select("id", "status", "stage", "progress", "error_message", "updated_at")


# Lists and texts

_WORDS = "list_filter(string_split(lower(LONG_COMMON_NAME), ' '), lambda w: length(w) > 3 AND w NOT IN ('mass', 'volume', 'moles', 'with', 'from', 'serum', 'plasma'))"


@query(f"SELECT row_no, list_filter(list_sort(list_distinct(list_concat([lower(COMPONENT)], {_WORDS}))), lambda w: w <> {_KEY})[1:6] AS aliases FROM ({L}) WHERE trim(COMPONENT) <> ''")
def build_aliases(spark: SparkSession, d: str) -> DataFrame:
    codes = b.lab_codes(spark, d).where(F.trim("COMPONENT") != "")
    return codes.select("row_no", catalog.build_aliases(F.col("COMPONENT"), F.col("LONG_COMMON_NAME"), fx.entity_key(F.col("COMPONENT"))).alias("aliases"))


def second_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A medicine-like catalog with aliases that clash with the tests'."""
    c = b.lab_catalog(spark, d).where(F.col("ord") % 3 == 0)
    return c.select(F.concat(F.lit("med_"), "id").alias("id"), "ord", F.array(F.upper(F.col("aliases")[0]), F.col("display_name")).alias("aliases"), "unit")


_SECOND = f"SELECT 'med_' || id AS id, ord, [aliases[1], display_name] AS aliases FROM ({C}) WHERE ord % 3 = 0"


@query(f"""
SELECT alias, arg_max(id, place) AS id FROM (SELECT unnest(aliases) AS alias, id, ord AS place FROM ({C}) UNION ALL SELECT unnest(aliases), id, 100000 + ord FROM ({_SECOND})) WHERE alias <> id GROUP BY alias
""")
def build_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return catalog.build_synonyms(b.lab_catalog(spark, d), second_catalog(spark, d))


_EXISTING = f"SELECT alias, arg_max(id, ord) AS id FROM (SELECT unnest(aliases) AS alias, id, ord FROM ({C})) GROUP BY alias"


@query(f"""
WITH e AS ({_EXISTING}) SELECT alias, id, false AS added FROM e UNION ALL
SELECT alias, arg_min(id, ord), true FROM (SELECT unnest(aliases) AS alias, id, ord FROM ({_SECOND})) WHERE alias NOT IN (SELECT alias FROM e) GROUP BY alias
""")
def extend_synonyms(spark: SparkSession, d: str) -> DataFrame:
    c = b.lab_catalog(spark, d)
    existing = catalog.build_synonyms(c, c.limit(0))
    return catalog.extend_synonyms(existing, second_catalog(spark, d))


@query(f"SELECT variant, canonical FROM (VALUES ('mg/dl', 'mg/dL'), ('g/dl', 'g/dL'), ('iu/l', 'IU/L')) t(variant, canonical) UNION ALL SELECT DISTINCT lower(unit), unit FROM ({L}) WHERE unit NOT IN ('', 'mg/dL')")
def build_unit_map(spark: SparkSession, d: str) -> DataFrame:
    return catalog.build_unit_map(b.units(spark), b.lab_codes(spark, d).select("unit", F.col("row_no").alias("ord")))


@query(f"""
WITH q AS (SELECT doc_id, q, min(rn * 4 + i) AS place FROM (SELECT doc_id, unnest(questions) AS q, unnest(range(len(questions))) AS i, row_number() OVER (PARTITION BY doc_id ORDER BY pos, name, value) AS rn FROM ({_ENRICHED}) WHERE is_abnormal) GROUP BY 1, 2)
SELECT d.doc_id, coalesce(list(q ORDER BY place)[1:8], []) AS questions FROM (SELECT DISTINCT doc_id FROM ({M})) d LEFT JOIN q USING (doc_id) GROUP BY d.doc_id HAVING count(q) > 0 UNION ALL
SELECT doc_id, [] FROM ({_CLASSIFIED}) GROUP BY doc_id HAVING NOT bool_or(is_abnormal)
""")
def build_questions(spark: SparkSession, d: str) -> DataFrame:
    """Values that are alike in all that they are ordered by, but not in their ranges, come in the order of the table."""
    return report.build_questions(enriched(spark, d), order=("pos", "name", "value", "place"))


_STEPS = "CASE WHEN NOT bool_or(is_abnormal) THEN ['Continue healthy habits', 'Repeat routine tests in 6–12 months'] WHEN bool_or(severity IN ('severe', 'critical')) THEN ['Consult your doctor within 1–2 weeks', 'Seek medical advice urgently', 'Repeat abnormal tests if advised'] ELSE ['Consult your doctor within 1–2 weeks', 'Repeat abnormal tests if advised'] END"


@query(f"SELECT doc_id, {_STEPS} AS next_steps FROM ({_CLASSIFIED}) GROUP BY doc_id")
def build_next_steps(spark: SparkSession, d: str) -> DataFrame:
    return report.build_next_steps(enriched(spark, d))


@query(f"""
WITH e AS ({_ENTITIES}), c AS ({C}), a AS (SELECT display_name AS alias FROM c UNION ALL SELECT aliases[1] FROM c),
n AS (SELECT doc_id, sum(len(regexp_extract_all(lower(regexp_replace(text, '\\s+', ' ', 'g')), alias || '\\s*[:\\-]?\\s*\\d'))) AS n FROM documents JOIN a ON contains(lower(text), alias) GROUP BY doc_id)
SELECT d.doc_id, coalesce(list(id ORDER BY first_pos, ord) FILTER (id IS NOT NULL), []) AS medicines, CAST(coalesce(any_value(n), 0) AS INT) AS n_tests FROM documents d LEFT JOIN e USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
""")
def parse_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = b.table(spark, d, "documents").select("doc_id", "text")
    parsed = extract.parse_documents(docs, b.lab_catalog(spark, d), b.medicine_catalog(spark), b.units(spark))
    return parsed.select("doc_id", F.transform("medicines", lambda m: m["id"]).alias("medicines"), F.size("tests").alias("n_tests"))


@query(f"""
SELECT doc_id, coalesce(list(name || '|' || value_str || '|' || normal_range_str || '|' || severity || '|' || meaning ORDER BY pos, name, value) FILTER (is_abnormal), []) AS abnormal,
  coalesce(list(name || '|' || value_str ORDER BY pos, name, value) FILTER (NOT is_abnormal), []) AS normal,
  CASE WHEN bool_or(is_abnormal) THEN count(*) FILTER (is_abnormal) || ' value(s) are outside the normal range.' ELSE 'All detected values are within normal ranges.' END AS overall_summary, 0.25::DOUBLE AS confidence_score, {_STEPS} AS next_steps
FROM ({_ENRICHED}) GROUP BY doc_id
""")
def rule_based_report(spark: SparkSession, d: str) -> DataFrame:
    """Values that are alike in all that they are ordered by, but not in their ranges, come in the order of the table."""
    m = b.measurements(spark, d)
    meds = spark.createDataFrame([], "doc_id long, id string, name string, first_pos int, ord long")
    m = m.withColumn("name_key", F.col("name")).withColumn("value_key", F.col("value"))
    r = report.rule_based_report(m.select("doc_id").distinct(), m, meds, b.lab_catalog(spark, d), b.medicine_catalog(spark), order=("pos", "name_key", "value_key", "place"))
    text = lambda e, names: F.concat_ws("|", *[e[n] for n in names])
    return r.select(
        "doc_id", F.transform("abnormal_values", lambda e: text(e, ("test_name", "value", "normal_range", "severity", "what_it_means"))).alias("abnormal"), F.transform("normal_values", lambda e: text(e, ("test_name", "value"))).alias("normal"),
        "overall_summary", "confidence_score", "next_steps",
    )


@query(f"""
WITH c AS ({C}) SELECT id AS entity_id, 1 AS chunk_no, display_name || ' is a ' || category || ' lab test. Also known as: ' || aliases[1] || '. Measured in mg/dl. Normal range: ' || normal_min || '–' || normal_max || ' mg/dl.' AS content, 'factual' AS chunk_type FROM c
UNION ALL SELECT id, 2, display_name || ': ' || coalesce(meaning, '') || '  Common causes of abnormality: ' || category || '.', 'clinical' FROM c
""")
def test_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = b.lab_catalog(spark, d)
    return knowledge.test_chunks(c.withColumns({k: F.col(k).cast("string") for k in ("normal_min", "normal_max")})).select("entity_id", "chunk_no", "content", "chunk_type")


@query(f"""
SELECT 'med_' || id AS entity_id, display_name || ' is a ' || category || ' medication. Brand names: ' || upper(aliases[1]) || '.' || coalesce(' ' || meaning, '') AS content FROM ({C}) WHERE ord % 3 = 0
""")
def medicine_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = b.lab_catalog(spark, d).where(F.col("ord") % 3 == 0)
    meds = c.select(F.concat(F.lit("med_"), "id").alias("id"), "ord", "display_name", "category", F.array(F.upper(F.col("aliases")[0]), F.col("display_name")).alias("aliases"), F.col("meaning").alias("purpose"))
    return knowledge.medicine_chunks(meds).select("entity_id", "content")


@query("SELECT vec_id, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 64) AS BIGINT) AS batch FROM embeddings")
def assign_batches(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.assign_batches(b.table(spark, d, "embeddings").select("vec_id"), "vec_id").select("vec_id", "batch")


@query(f"SELECT doc_id, string_agg(name || ' ' || value || ' mg/dl', ' ' ORDER BY pos, name, value) || ' extra' AS query FROM ({M}) GROUP BY doc_id")
def build_query_text(spark: SparkSession, d: str) -> DataFrame:
    m = b.measurements(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "value", "unit"))).alias("tests"))
    return knowledge.build_query_text(m.withColumn("medicines", F.array(F.struct(F.lit("extra").alias("name")))))


@query("""
SELECT conv_id * 1000 + turn AS doc_id, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS with_context, least(length(text), 8001) AS n_text, 2 AS n_messages FROM conversations WHERE text IS NOT NULL
""")
def build_requests(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    t = b.table(spark, d, "conversations").where(F.col("text").isNotNull()).select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("text").alias("raw_text"), none.alias("tests"), none.alias("medicines"))
    context = t.where(F.col("conv_id") % 2 == 0).select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), F.lit("chunk").alias("content"))
    r = responses.build_requests(t.drop("conv_id"), context, "Answer in JSON.", "Return JSON only.")
    user = F.col("messages")[1]["content"]
    length = F.length(F.get_json_object("payload", "$.parsed_data.raw_text")).cast("long")
    return r.select("doc_id", F.contains(user, F.lit("chunk\n---\nchunk")).cast("int").alias("with_context"), length.alias("n_text"), F.size("messages").alias("n_messages"))


# Top-k


def _hits(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "embeddings")
    queries = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return vectors.vector_topk(queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))


_COSINE = "1 - list_sum(list_transform(list_zip(q.v, k.v), lambda p: p[1] * p[2])) / (q.n * k.n)"
_HITS = f"""
WITH k AS (SELECT vec_id AS id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)), q AS (SELECT * FROM k WHERE id % 50 = 0)
SELECT q.id AS query_id, k.id AS id, {_COSINE} AS dist, row_number() OVER (PARTITION BY q.id ORDER BY round({_COSINE}, 12), k.id) AS rank FROM q, k QUALIFY rank <= 5
"""


@query(f"SELECT query_id, id, CAST(rank AS INT) AS rank, round(dist, 4) + 0.0 AS dist FROM ({_HITS})")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query_id", "id", "rank", (F.round("dist", 4) + F.lit(0.0)).alias("dist"))


@query(f"SELECT query_id, id FROM ({_HITS}) WHERE dist < 0.6")
def within_distance(spark: SparkSession, d: str) -> DataFrame:
    return vectors.within_distance(_hits(spark, d)).select("query_id", "id")


# Result documents


def repaired(spark: SparkSession, d: str) -> DataFrame:
    return responses.repair_json(b.responses(spark, d))


_CLEAN = r"trim(text, ' ' || chr(10) || chr(9) || chr(13))"


@query(f"SELECT job_id, CASE WHEN conv_id % 4 = 3 THEN 'none' ELSE {_CLEAN} END AS summary, CASE WHEN conv_id % 4 = 3 THEN 'none' WHEN conv_id % 3 = 0 THEN '0.75' ELSE 'x' END AS confidence FROM ({RESPONSES})")
def ensure_str(spark: SparkSession, d: str) -> DataFrame:
    get = lambda n: sanitize.ensure_str(sanitize.field(F.col("doc"), n), "none")
    return repaired(spark, d).select("job_id", get("overall_summary").alias("summary"), get("confidence_score").alias("confidence"))


@query(f"SELECT job_id, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE 1 END AS n_summary, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE 1 END AS n_steps, 0 AS n_flags FROM ({RESPONSES})")
def ensure_list(spark: SparkSession, d: str) -> DataFrame:
    n = lambda name: F.size(sanitize.ensure_list(sanitize.field(F.col("doc"), name)))
    return repaired(spark, d).select("job_id", n("overall_summary").alias("n_summary"), n("next_steps").alias("n_steps"), n("red_flags").alias("n_flags"))


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return sanitize.sanitize_results(repaired(spark, d), raw="doc", out="clean")


@query(f"""
SELECT job_id, CASE WHEN conv_id % 4 = 3 THEN 'No data available' ELSE {_CLEAN} END AS overall_summary, CASE WHEN conv_id % 4 <> 3 AND conv_id % 3 = 0 THEN 0.75 ELSE 0 END::DOUBLE AS confidence_score,
  CASE WHEN conv_id % 4 <> 3 THEN 'urgent' END AS urgency_level, CASE WHEN conv_id % 4 = 3 THEN 'unknown' WHEN conv_id % 5 = 0 THEN 'Prescription' ELSE 'lab' END AS document_type FROM ({RESPONSES})
""")
def sanitize_header(spark: SparkSession, d: str) -> DataFrame:
    return cleaned(spark, d).select("job_id", "clean.overall_summary", "clean.confidence_score", "clean.urgency_level", "clean.input_summary.document_type")


@query(f"""
SELECT job_id, CASE WHEN conv_id % 4 = 3 OR conv_id % 5 = 0 OR turn % 3 = 0 THEN [] ELSE ['t' || turn || '|12 mg|unknown'] END AS abnormal, CASE WHEN conv_id % 4 = 3 OR conv_id % 5 = 0 THEN [] ELSE ['n'] END AS normal FROM ({RESPONSES})
""")
def sanitize_test_entries(spark: SparkSession, d: str) -> DataFrame:
    text = lambda e: F.concat_ws("|", e["test_name"], e["value"], e["severity"])
    return cleaned(spark, d).select("job_id", F.transform("clean.abnormal_values", text).alias("abnormal"), F.transform("clean.normal_values", lambda e: e["test_name"]).alias("normal"))


@query(f"SELECT job_id, CASE WHEN conv_id % 4 = 3 THEN [] ELSE ['m|Prescribed by your doctor.|3'] END AS medicines FROM ({RESPONSES})")
def sanitize_medicines(spark: SparkSession, d: str) -> DataFrame:
    text = lambda m: F.concat_ws("|", m["name"], m["purpose"], F.size(m["common_side_effects"]).cast("string"))
    return cleaned(spark, d).select("job_id", F.transform("clean.medicines", text).alias("medicines"))


@query(f"""
SELECT job_id, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE 1 END AS n_medicines, CASE WHEN conv_id % 4 = 3 OR conv_id % 5 = 0 OR turn % 3 = 0 THEN 0 ELSE 1 END AS n_abnormal, CASE WHEN conv_id % 4 = 3 THEN '' ELSE 'd' END AS disclaimer, true AS same_again FROM ({RESPONSES})
""")
def sanitize_results(spark: SparkSession, d: str) -> DataFrame:
    again = cleaned(spark, d).withColumn("again", sanitize.sanitize_column(F.parse_json(F.to_json("clean"))))
    same = F.to_json("clean") == F.to_json("again")
    return again.select("job_id", F.size("clean.medicines").alias("n_medicines"), F.size("clean.abnormal_values").alias("n_abnormal"), "clean.disclaimer", same.alias("same_again"))


@query(f"""
SELECT job_id, conforms, CASE WHEN conv_id % 4 = 3 THEN 'No data available' ELSE {_CLEAN} END AS overall_summary, CASE WHEN conforms AND conv_id % 4 <> 3 THEN 1 ELSE 0 END AS n_steps,
  CASE WHEN NOT conforms THEN 'Result temporarily unavailable' WHEN conv_id % 4 = 3 THEN 'No data available' ELSE {_CLEAN} END AS cached_summary, NOT conforms AS said_cached
FROM (SELECT *, conv_id % 4 = 3 OR (conv_id % 7 <> 0 AND conv_id % 11 <> 0) AS conforms FROM ({RESPONSES}))
""")
def conform_results(spark: SparkSession, d: str) -> DataFrame:
    """The stored safe form beside the cached one."""
    stored = sanitize.conform_results(cleaned(spark, d).withColumn("kept", F.col("clean")), "clean").drop("conforms")
    both = sanitize.conform_results(stored, "kept", cached=True)
    return both.select("job_id", "conforms", "clean.overall_summary", F.size("clean.next_steps").alias("n_steps"), F.col("kept.overall_summary").alias("cached_summary"), F.col("kept.metadata.cached").alias("said_cached"))


@query(f"""
SELECT job_id, CASE WHEN conv_id % 4 = 3 OR conv_id % 5 = 0 OR turn % 3 = 0 THEN 0 ELSE 1 END AS abnormal, CASE WHEN conv_id % 4 = 3 OR conv_id % 5 = 0 THEN 0 ELSE 1 END AS normal,
  CASE WHEN conv_id % 4 = 3 THEN 0 ELSE 1 END AS medicines, CASE WHEN conv_id % 4 <> 3 AND conv_id % 3 = 0 THEN 75 ELSE 0 END AS confidence_percent FROM ({RESPONSES})
""")
def document_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.document_counts(cleaned(spark, d).select("job_id", F.col("clean").alias("doc")))


@query(f"SELECT job_id, 'completed' AS status, CASE WHEN conv_id % 4 = 3 THEN 'rules' ELSE 'model' END AS source, CASE WHEN conv_id % 4 = 3 THEN 'rule' ELSE {_CLEAN} END AS overall_summary FROM ({RESPONSES})")
def finalize_results(spark: SparkSession, d: str) -> DataFrame:
    r = b.responses(spark, d)
    reports = r.select("job_id", F.struct(F.lit("rule").alias("overall_summary"), F.lit(0.25).alias("confidence_score")).alias("report"))
    return responses.finalize_results(r, reports, r.select("job_id")).select("job_id", "status", "source", "doc.overall_summary")


# Streams: batch twins, and the streams themselves over the same tables

_LIMIT = """
WITH RECURSIVE r AS (SELECT event_id, user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT event_id, key, ts, i, ts AS start, 1 AS n FROM r WHERE i = 1 UNION ALL
SELECT r.event_id, r.key, r.ts, r.i, CASE WHEN r.ts >= w.start + INTERVAL 1 DAY THEN r.ts ELSE w.start END, CASE WHEN r.ts >= w.start + INTERVAL 1 DAY THEN 1 ELSE w.n + 1 END FROM w JOIN r ON r.key = w.key AND r.i = w.i + 1)
SELECT event_id, key, start AS window_start, n, n <= 3 AS allowed FROM w
"""


@query(_LIMIT)
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return limits.rate_limit(b.requests(spark, d), 3, 86400).select("event_id", "key", "window_start", "n", "allowed")


def streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    # As a pattern, since a stream takes a single file only from one.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/{name}[.]parquet")


@query(_LIMIT)
def rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """Requests that come up to six hours late, a quarter of them in each micro-batch, and at the end a row without key that is later than all."""
    late, path = 6 * 3600, b_path(spark, "requests")
    rows = b.requests(spark, d).select("event_id", "key", F.col("ts").cast("timestamp").alias("ts"))
    comes = F.timestamp_add("SECOND", F.pmod(F.col("event_id") * 7919, F.lit(late)), F.col("ts"))
    first, last = rows.select(F.min("ts"), F.max("ts")).first()
    cuts = [F.lit(first + (last - first) * k / 4) for k in range(1, 4)]
    part = sum((F.when(comes >= c, 1).otherwise(0) for c in cuts), F.lit(0))

    def come() -> Iterator[int]:
        for k in range(4):
            rows.where(part == k).write.parquet(f"{path}/part={k}")
            yield k
        rows.limit(0).unionByName(spark.sql("SELECT -1L AS event_id, CAST(NULL AS BIGINT) AS key, TIMESTAMP '2100-01-01' AS ts")).write.parquet(f"{path}/part=4")
        yield 4

    rows.limit(0).write.parquet(f"{path}/part=-1")  # a stream's folder has to be there
    events = spark.readStream.schema("event_id long, key long, ts timestamp, part int").parquet(path)
    out = stateful.run_to_table(limits.rate_limit_stream(events, 3, 86400, f"{late} seconds"), "rate-limit", runs=come())
    return spark.read.parquet(out).select("event_id", "key", "window_start", "n", "allowed")


@query(f"""
SELECT 'entity' AS kind, -1 - doc_id AS doc_id, id, category AS what, CAST(NULL AS DOUBLE) AS value FROM ({_ENTITIES}) UNION ALL
SELECT 'measurement', doc_id, id, unit, CAST(value AS DOUBLE) FROM ({_HITS_SQL})
""")
def stream_extract(spark: SparkSession, d: str) -> DataFrame:
    """A stream of the documents, by negative ids, and of the orders' reports, from files in the shared folder."""
    path, source = b_path(spark, "extracted"), b_path(spark, "texts")
    texts = b.report_text(spark, d).unionByName(b.table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    texts.hint("rebalance").write.parquet(source)  # reports and documents in all files alike: what a file holds to be found doesn't follow from its bytes
    stateful.run_to_table(spark.readStream.schema(texts.schema).parquet(source), "extract", write=stateful.stream_extract(b.lab_catalog(spark, d), b.medicine_catalog(spark), b.units(spark), path))
    entities = stateful.read_entities(spark, path).where(F.col("doc_id") < 0)
    values = stateful.read_measurements(spark, path).where(F.col("doc_id") >= 0)
    return entities.select(F.lit("entity").alias("kind"), "doc_id", "id", F.col("category").alias("what"), F.lit(None).cast("double").alias("value")).unionByName(
        values.select(F.lit("measurement").alias("kind"), "doc_id", "id", F.col("unit").alias("what"), "value")
    )


@query("SELECT user_id AS job_id, min(ts) AS ts FROM events GROUP BY user_id")
def process_once(spark: SparkSession, d: str) -> DataFrame:
    return stateful.process_once(b.table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts"), "ts")


@query(f"SELECT job_id, status, stage, {_PROGRESS.format(c='stage')} AS progress, error, updated_at FROM ({_LAST})")
def job_state(spark: SparkSession, d: str) -> DataFrame:
    return stateful.job_state(b.job_events(spark, d))


@query("SELECT DISTINCT user_id AS job_id FROM events")
def process_once_stream(spark: SparkSession, d: str) -> DataFrame:
    events = streamed(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"))
    return spark.read.parquet(stateful.run_to_table(stateful.process_once(events, "ts", "60 days"), "once")).select("job_id")


@query(f"SELECT job_id, status, stage, {_PROGRESS.format(c='stage')} AS progress, updated_at FROM ({_LAST})")
def job_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """All there is now comes as one batch or more; the last state of each job is the answer."""
    out = spark.read.parquet(stateful.run_to_table(stateful.job_state(b.job_events_of(streamed(spark, d, "events"))), "job-state", "update"))
    state = ("status", "stage", "progress", "updated_at")
    return out.groupBy("job_id").agg(F.max_by(F.struct(*state), "updated_at").alias("s")).select("job_id", *[f"s.{c}" for c in state])


_END = "2024-01-15 12:00:00"


@query(f"""
SELECT job_id, max(ts) AS stuck_since FROM ({b.JOB_EVENTS_SQL}) WHERE ts <= TIMESTAMP '{_END}' GROUP BY job_id
HAVING arg_max(status, ts) = 'processing' AND max(ts) < TIMESTAMP '{_END}' - INTERVAL 10 MINUTE
""")
def stuck_alerts(spark: SparkSession, d: str) -> DataFrame:
    return stateful.stuck_alerts(b.job_events(spark, d), _END)


@query(f"SELECT job_id, updated_at AS stuck_since FROM ({_LAST}) WHERE status = 'processing' AND updated_at + INTERVAL 10 MINUTE < (SELECT max(ts) FROM events)")
def stuck_alerts_stream(spark: SparkSession, d: str) -> DataFrame:
    """Event time stands at the last event when all there is has come."""
    events = b.job_events_of(streamed(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return spark.read.parquet(stateful.run_to_table(stateful.stuck_alerts_stream(events), "stuck")).select("job_id", "stuck_since")


_LIVE = f"SELECT job_id, arg_max(doc, written_at) AS doc, max(written_at) AS written_at FROM ({b.CACHE_SQL}) WHERE written_at + ttl_sec * INTERVAL 1 SECOND > TIMESTAMP '{_END}' GROUP BY job_id"


@query(_LIVE)
def latest_cached(spark: SparkSession, d: str) -> DataFrame:
    return stateful.latest_cached(b.cache_rows(spark, d), _END)


@query(f"""
WITH n AS (SELECT job_id, arg_max(doc, written_at) AS doc, max(written_at) AS written_at, arg_max(ttl_sec, written_at) AS ttl_sec FROM ({b.CACHE_SQL}) GROUP BY job_id)
SELECT job_id, doc, written_at, true AS live FROM n UNION ALL SELECT job_id, doc, written_at, false FROM n WHERE written_at + ttl_sec * INTERVAL 1 SECOND < (SELECT max(ts) FROM events)
""")
def latest_cached_stream(spark: SparkSession, d: str) -> DataFrame:
    """One batch holds all there is now, so each job's newest document comes once, and again where its time is over."""
    rows = b.cache_rows_of(streamed(spark, d, "events"))
    return spark.read.parquet(stateful.run_to_table(stateful.latest_cached_stream(rows), "cached")).select("job_id", "doc", "written_at", "live")
