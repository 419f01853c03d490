"""The driver tables as inputs of the operators: reports, catalogs, jobs, requests, pages and responses derived by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = "1998-01-01 00:00:00"
#: Words of four letters and more that are frequent in some documents, as entity names.
MEDICINES = [("that", "A", ["This"]), ("nicht", "B", ["sich", "Auch"]), ("dans", "C", ["pour", "Avec"]), ("para", "D", ["como", "Este"]), ("tion", "E", ["with"])]
UNITS = [("mg/dl", "mg/dL"), ("g/dl", "g/dL"), ("iu/l", "IU/L")]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """One measurement a line item: its quantity against a range from the part's size, and its row's place in the table. A part table is joined as Spark sees fit."""
    place = F.struct("_metadata.file_name", "_metadata.row_index").alias("place")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", place)
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("id"), F.col("p_name").alias("name"), F.col("l_quantity").alias("value"),
        F.lit("mg/dl").alias("unit"), (F.col("p_size") * F.lit(0.5)).cast("double").alias("normal_min"), F.col("p_size").cast("double").alias("normal_max"), "place",
    )


def lab_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A test for each part name, with its second word as alias (shared by several on purpose); ord by name."""
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_type").alias("category"), F.floor(F.avg("p_size") * 0.5).cast("double").alias("normal_min"), F.floor(F.avg("p_size")).cast("double").alias("normal_max"))
    number = F.dense_rank().over(Window.orderBy("p_name")).cast("long")
    none = F.lit(None).cast("string")
    return p.select(
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("id"), number.alias("ord"), F.col("p_name").alias("display_name"), "category", F.array(F.split("p_name", " ")[1]).alias("aliases"), F.lit("mg/dl").alias("unit"),
        "normal_min", "normal_max", F.when(F.startswith("p_name", F.lit("b")), F.concat(F.lit("About "), "p_name")).otherwise(none).alias("meaning"), none.alias("normal_meaning"), F.array("category").alias("common_causes"),
    )


def medicine_catalog(spark: SparkSession) -> DataFrame:
    rows = [(k, i, k.title(), c, a) for i, (k, c, a) in enumerate(MEDICINES)]
    return spark.createDataFrame(rows, "id string, ord long, display_name string, category string, aliases array<string>").withColumn("purpose", F.concat(F.lit("Helps with "), "category"))


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, "variant string, canonical string")


def report_text(spark: SparkSession, d: str) -> DataFrame:
    """A text for each order: its parts with their quantities, in order."""
    m = measurements(spark, d)
    piece = F.concat("name", F.lit(": "), F.col("value").cast("string"), F.lit(" mg/dl"))
    rows = m.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "value", piece.alias("t")))).alias("r"))
    return rows.select("doc_id", F.array_join("r.t", " ").alias("text"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    status = (
        F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderpriority") == "1-URGENT", "failed")
        .when(F.col("o_orderpriority") == "5-LOW", "expired").otherwise("completed")
    )
    age = F.timestamp_add("DAY", (F.col("o_orderkey") % 30).cast("int"), F.col("o_orderdate").cast("timestamp"))
    stage = F.when(status == "processing", "parsing").when(status == "queued", "uploading").otherwise("done")
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("uploads/"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))).otherwise("").alias("file_path"), status.alias("status"), stage.alias("stage"),
        F.when(status == "processing", 45).when(status == "queued", 5).otherwise(100).alias("progress"), F.when((status == "failed") & (F.col("o_orderkey") % 2 == 0), "OCR failure").alias("error_message"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), age.alias("updated_at"),
    )


JOBS_SQL = """
SELECT id, CASE WHEN id % 5 <> 0 THEN 'uploads/' || id || '.pdf' ELSE '' END AS file_path, status,
  CASE status WHEN 'processing' THEN 'parsing' WHEN 'queued' THEN 'uploading' ELSE 'done' END AS stage,
  CASE status WHEN 'processing' THEN 45 WHEN 'queued' THEN 5 ELSE 100 END AS progress,
  CASE WHEN status = 'failed' AND id % 2 = 0 THEN 'OCR failure' END AS error_message, created_at, updated_at
FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate + (o_orderkey % 30) * INTERVAL '1' DAY AS TIMESTAMP) AS updated_at,
  CASE WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderpriority = '1-URGENT' THEN 'failed'
       WHEN o_orderpriority = '5-LOW' THEN 'expired' ELSE 'completed' END AS status FROM orders)
"""

MEASUREMENTS_SQL = """
SELECT l_orderkey AS doc_id, l_linenumber AS pos, replace(p_name, ' ', '_') AS id, p_name AS name, l_quantity AS value, 'mg/dl' AS unit,
  p_size * CAST(0.5 AS DOUBLE) AS normal_min, CAST(p_size AS DOUBLE) AS normal_max FROM lineitem JOIN part ON l_partkey = p_partkey
"""

CATALOG_SQL = """
SELECT replace(p_name, ' ', '_') AS id, row_number() OVER (ORDER BY p_name) AS ord, p_name AS display_name, min(p_type) AS category, [split_part(p_name, ' ', 2)] AS aliases,
  'mg/dl' AS unit, CAST(floor(avg(p_size) * 0.5) AS DOUBLE) AS normal_min, CAST(floor(avg(p_size)) AS DOUBLE) AS normal_max,
  CASE WHEN p_name LIKE 'b%' THEN 'About ' || p_name END AS meaning, [min(p_type)] AS common_causes FROM part GROUP BY p_name
"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), "ts")


def job_events(spark: SparkSession, d: str) -> DataFrame:
    return job_events_of(table(spark, d, "events"))


def job_events_of(e: DataFrame) -> DataFrame:
    """Events as changes of a user's job."""
    stage = F.element_at(F.array(*[F.lit(s) for s in ("extracting_text", "parsing", "finalizing", "done")]), (F.col("event_id") % 4 + 1).cast("int"))
    status = F.when(F.col("event_id") % 4 == 3, "completed").otherwise("processing")
    return e.select(F.col("user_id").alias("job_id"), "ts", status.alias("status"), stage.alias("stage"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error"))


JOB_EVENTS_SQL = """
SELECT user_id AS job_id, ts, CASE WHEN event_id % 4 = 3 THEN 'completed' ELSE 'processing' END AS status,
  ['extracting_text', 'parsing', 'finalizing', 'done'][event_id % 4 + 1] AS stage, CASE WHEN event_id % 7 = 0 THEN 'error ' || event_id END AS error FROM events
"""


def cache_rows(spark: SparkSession, d: str) -> DataFrame:
    return cache_rows_of(table(spark, d, "events"))


def cache_rows_of(e: DataFrame) -> DataFrame:
    """Events as cached documents of a user's job."""
    return e.select(F.col("user_id").alias("job_id"), F.concat(F.lit("doc "), F.col("event_id").cast("string")).alias("doc"), F.col("ts").cast("timestamp").alias("written_at"), F.when(F.col("event_id") % 2 == 0, 3600).otherwise(86400).alias("ttl_sec"))


CACHE_SQL = "SELECT user_id AS job_id, 'doc ' || event_id AS doc, ts AS written_at, CASE WHEN event_id % 2 = 0 THEN 3600 ELSE 86400 END AS ttl_sec FROM events"


def lab_codes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows of a code list: components are words of parts and of the priority list, with clashing keys."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(k / n) % len(values) + 1).cast("int"))
    component = F.concat_ws(" ", pick(COMPONENTS, 1), F.when(k % 3 == 0, (F.floor(k / 7) % 40).cast("string")))
    return c.select(
        k.alias("row_no"), component.alias("COMPONENT"), pick(("Ser/Plas", "Urine", "Bld", "Hair", "XXX"), 2).alias("SYSTEM"), pick(("MCnc", "", "Find"), 5).alias("PROPERTY"), pick(("Qn", "Nom", ""), 3).alias("SCALE_TYP"),
        pick(("ACTIVE", "ACTIVE", "", "DEPRECATED"), 4).alias("STATUS"), F.concat(component, F.lit(" [Mass/volume] in Serum with extra name")).alias("LONG_COMMON_NAME"), pick(("mg/dL", "", "U/L"), 6).alias("unit"),
    )


COMPONENTS = ("Glucose", "Hemoglobin A1c", "Zinc", "Cholesterol in HDL", "Copper/Zinc", "Lead", "Iron", "Selenium", " ", "Vitamin D", "Nickel", "Creatinine")
_PICK = "[{values}][CAST(floor(c_custkey / {n}) AS BIGINT) % {size} + 1]"


def _pick_sql(values: tuple, n: int) -> str:
    return _PICK.format(values=", ".join(f"'{v}'" for v in values), n=n, size=len(values))


_COMPONENT_SQL = f"{_pick_sql(COMPONENTS, 1)} || CASE WHEN c_custkey % 3 = 0 THEN ' ' || CAST(CAST(floor(c_custkey / 7) AS BIGINT) % 40 AS VARCHAR) ELSE '' END"
CODES_SQL = f"""
SELECT c_custkey AS row_no, {_COMPONENT_SQL} AS COMPONENT, {_pick_sql(("Ser/Plas", "Urine", "Bld", "Hair", "XXX"), 2)} AS SYSTEM, {_pick_sql(("MCnc", "", "Find"), 5)} AS PROPERTY,
  {_pick_sql(("Qn", "Nom", ""), 3)} AS SCALE_TYP, {_pick_sql(("ACTIVE", "ACTIVE", "", "DEPRECATED"), 4)} AS STATUS, {_COMPONENT_SQL} || ' [Mass/volume] in Serum with extra name' AS LONG_COMMON_NAME,
  {_pick_sql(("mg/dL", "", "U/L"), 6)} AS unit FROM customer
"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as result documents, wrapped as clean, fenced, buried or truncated text."""
    t = table(spark, d, "conversations").where((F.col("role") == "assistant") & F.col("text").isNotNull())
    doc = F.to_json(
        F.struct(
            F.col("text").alias("overall_summary"), F.lit("d").alias("disclaimer"), F.struct(F.when(F.col("conv_id") % 5 == 0, "Prescription").otherwise("lab").alias("document_type")).alias("input_summary"),
            F.array(F.struct(F.concat(F.lit("t"), F.col("turn").cast("string")).alias("test_name"), F.when(F.col("turn") % 3 == 0, "1 tablet daily").otherwise("12 mg").alias("value"), F.lit("BANANA").alias("severity"))).alias("abnormal_values"),
            F.array(F.struct(F.lit("n").alias("test_name"), F.lit("mild").alias("severity"))).alias("normal_values"), F.array(F.struct(F.lit("m").alias("name"), F.array(*[F.lit(x) for x in "abcd"]).alias("common_side_effects"))).alias("medicines"),
            F.array(F.lit("q")).alias("questions_to_ask_doctor"), F.array(F.lit("s")).alias("next_steps"), F.when(F.col("conv_id") % 3 == 0, "0.75").otherwise("x").alias("confidence_score"), F.lit("URGENT").alias("urgency_level"),
        )
    )
    # Every seventh conversation has a number among its steps, and every eleventh text in place of an analysis.
    doc = F.when(F.col("conv_id") % 7 == 0, F.replace(doc, F.lit('"next_steps":["s"]'), F.lit('"next_steps":[7]'))).otherwise(doc)
    doc = F.when(F.col("conv_id") % 11 == 0, F.replace(doc, F.lit('"urgency_level":"URGENT"'), F.lit('"urgency_level":"URGENT","pattern_analysis":"x"'))).otherwise(doc)
    wrapped = (
        F.when(F.col("conv_id") % 4 == 0, doc).when(F.col("conv_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), doc, F.lit("\n```")))
        .when(F.col("conv_id") % 4 == 2, F.concat(F.lit("Sure. "), doc, F.lit(" Done."))).otherwise(F.concat(F.substring(doc, 1, 40)))
    )
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), wrapped.alias("text"))
