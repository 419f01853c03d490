"""Knowledge chunks and exact retrieval by vector distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.functions.text import content_id, filled, float_text, truncate_words
from assayflow.sources.shared import numbered
from assayflow.sources.versions import upsert_version


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# The sentences of chunks, here and in medicine_chunks(), are what is stored and searched.
def test_chunks(catalog: DataFrame) -> DataFrame:
    """ord, chunk_no, content, source, entity_id, category, chunk_type: a factual and, with a meaning or causes, a clinical text of every test.

    catalog(id, ord, display_name, category, unit, normal_min, normal_max as text, meaning, normal_meaning, common_causes, aliases).
    """
    low, high, unit = F.col("normal_min"), F.col("normal_max"), F.coalesce("unit", F.lit(""))
    name, category = F.coalesce("display_name", "id"), F.coalesce("category", F.lit("unknown"))
    span = F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("Normal range: "), low, F.lit("–"), high, F.lit(" "), unit, F.lit("."))).when(high.isNotNull(), F.concat(F.lit("Normal: below "), high, F.lit(" "), unit, F.lit("."))).otherwise("")
    known = F.when(F.size("aliases") > 0, F.concat(F.lit(" Also known as: "), F.array_join(F.slice("aliases", 1, 4), ", "), F.lit("."))).otherwise("")
    factual = _strip(F.concat(name, F.lit(" is a "), category, F.lit(" lab test."), known, F.lit(" Measured in "), unit, F.lit(". "), span))
    has_causes = F.coalesce(F.size("common_causes") > 0, F.lit(False))
    causes = F.when(has_causes, F.concat(F.lit(" Common causes of abnormality: "), F.array_join(F.slice("common_causes", 1, 5), ", "), F.lit("."))).otherwise("")
    clinical = _strip(F.concat(name, F.lit(": "), F.coalesce("meaning", F.lit("")), F.lit(" "), F.coalesce("normal_meaning", F.lit("")), causes))
    wanted = filled("meaning").isNotNull() | has_causes
    one = lambda no, text, kind: F.struct(F.lit(no).alias("chunk_no"), text.alias("content"), F.lit(kind).alias("chunk_type"))
    both = F.array_compact(F.array(one(1, factual, "factual"), F.when(wanted, one(2, clinical, "clinical"))))
    rows = catalog.select(F.col("id").alias("entity_id"), "ord", category.alias("category"), F.inline(both))
    return rows.select("ord", "chunk_no", "content", F.lit("catalog_tests").alias("source"), "entity_id", "category", "chunk_type")


def medicine_chunks(catalog: DataFrame) -> DataFrame:
    """ord, chunk_no, content, source, entity_id, category, chunk_type (null): one text of every medicine, with up to five capitalised aliases as brands."""
    brands = F.slice(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.substring(a, 1, 1).rlike(r"\p{Lu}")), 1, 5)
    brand = F.when(F.size(brands) > 0, F.concat(F.lit(" Brand names: "), F.array_join(brands, ", "), F.lit("."))).otherwise("")
    purpose = F.coalesce(F.concat(F.lit(" "), truncate_words(filled("purpose"))), F.lit(""))
    category = F.coalesce("category", F.lit("unknown"))
    text = _strip(F.concat(F.coalesce("display_name", "id"), F.lit(" is a "), category, F.lit(" medication."), brand, purpose))
    return catalog.select("ord", F.lit(1).alias("chunk_no"), text.alias("content"), F.lit("catalog_medicines").alias("source"), F.col("id").alias("entity_id"), category.alias("category"), F.lit(None).cast("string").alias("chunk_type"))


def assign_batches(chunks: DataFrame, order: str = "ord", size: int = 64) -> DataFrame:
    """Adds batch: consecutive groups of `size` in order, for a remote client. Rows without order come first; ties are ordered by the other columns.

    Positions come from ranges of the order and the counts of those before (shared.numbered), not from one sorted task.
    """
    ties = F.xxhash64(*[c for c in chunks.columns if c != order] or [order])
    return numbered(chunks, F.col(order).asc_nulls_first(), ties, no="batch").withColumn("batch", F.floor(F.col("batch") / size))


KEY = ["entity_id", "chunk_type", "source"]


def keyed_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with their whole keys: a missing entity is the content's id, a missing source unknown."""
    return chunks.withColumns({"entity_id": F.coalesce("entity_id", content_id(F.col("content"))), "source": F.coalesce("source", F.lit("unknown"))})


def upsert_knowledge(target: DataFrame, chunks: DataFrame) -> DataFrame:
    """target without the rows whose (entity_id, chunk_type, source) a chunk has, nulls alike, and the chunks: of equal keys the last by ord.

    target and result: content, embedding, source, entity_id, chunk_type, metadata. The result belongs in a new
    version of the table, not over the one that is read: store_knowledge() makes one.
    """
    key, new = KEY, keyed_chunks(chunks)
    new = new.groupBy(*key).agg(F.max_by(F.struct("content", "embedding"), "ord").alias("last")).select(*key, F.col("last.content").alias("content"), F.col("last.embedding").alias("embedding"), F.lit("{}").alias("metadata"))
    columns = ["content", "embedding", *key, "metadata"]
    gone = new.select(*[F.col(k).alias(f"__{k}") for k in key])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return target.select(*columns).join(gone, same, "left_anti").unionByName(new.select(*columns))


def store_knowledge(path: str, chunks: DataFrame, commit: str | int | None = None) -> int:
    """Upsert chunks(content, embedding, entity_id, chunk_type, source, ord) into the table at path as its next version; versions.read_version() reads it."""
    rows = upsert_knowledge(chunks.limit(0).withColumn("metadata", F.lit("{}")), chunks.limit(0))
    return upsert_version(path, keyed_chunks(chunks), KEY, upsert_knowledge, commit, schema=rows.schema)


def build_query_text(parsed: DataFrame) -> DataFrame:
    """doc_id, query: name, value and unit of every test, then the medicines' names; null where there is nothing to ask."""
    test = lambda t: F.trim(F.concat_ws(" ", t["name"], float_text(t["value"]), t["unit"]))
    parts = F.concat(F.transform("tests", test), F.transform("medicines", lambda m: F.coalesce(m["name"], F.lit(""))))
    return parsed.select("doc_id", F.nullif(F.array_join(parts, " "), F.lit("")).alias("query"))
