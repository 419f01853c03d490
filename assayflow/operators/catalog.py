"""Building, filtering and merging catalogs from code systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.functions.text import entity_key, title_case, truncate_indication
from assayflow.sources.shared import numbered, stored

#: Which systems, properties and components of a code list count. Order matters in REFERENCE_RANGES and CATEGORIES.
SYSTEMS = ["ser", "plas", "bld", "ser/plas", "ser+plas", "urine", "ur", "bld.v", "rbc", "wbc", "blood"]
PROPERTIES = ["mcnc", "scnc", "ncnc", "mrat", "ccnc", "num", "enz", "mfr", "vfr", "acnc", "mcnt", "time", "threshold"]
PRIORITY = [
    "hemoglobin", "erythrocytes", "leukocytes", "platelets", "hematocrit", "glucose", "creatinine", "urea", "bilirubin", "cholesterol", "triglyceride", "hdl", "ldl",
    "aspartate aminotransferase", "alanine aminotransferase", "alkaline phosphatase", "albumin", "protein", "thyrotropin", "thyroxine", "triiodothyronine",
    "hemoglobin a1c", "sodium", "potassium", "chloride", "calcium", "phosphate", "magnesium", "iron", "ferritin", "vitamin d", "vitamin b12", "folate",
    "c reactive protein", "prothrombin", "inr", "troponin", "prostate specific ag",
]
#: (pattern, least, most, unit); hemoglobin has separate ranges besides.
REFERENCE_RANGES = [
    ("hemoglobin", 12.0, 17.0, "g/dL"), ("erythrocytes", 4.0, 5.5, "million/mcL"), ("leukocytes", 4000.0, 11000.0, "cells/mcL"), ("platelets", 150000.0, 450000.0, "cells/mcL"),
    ("glucose", 70.0, 100.0, "mg/dL"), ("creatinine", 0.6, 1.3, "mg/dL"), ("urea nitrogen", 7.0, 20.0, "mg/dL"), ("bilirubin.total", 0.1, 1.2, "mg/dL"), ("cholesterol", 0.0, 200.0, "mg/dL"),
    ("triglyceride", 0.0, 150.0, "mg/dL"), ("cholesterol in hdl", 40.0, 60.0, "mg/dL"), ("cholesterol in ldl", 0.0, 100.0, "mg/dL"), ("aspartate aminotransferase", 0.0, 40.0, "U/L"),
    ("alanine aminotransferase", 0.0, 40.0, "U/L"), ("alkaline phosphatase", 44.0, 147.0, "U/L"), ("albumin", 3.5, 5.0, "g/dL"), ("protein", 6.0, 8.3, "g/dL"), ("thyrotropin", 0.4, 4.0, "μIU/mL"),
    ("hemoglobin a1c", 4.0, 5.6, "%"), ("sodium", 136.0, 145.0, "mEq/L"), ("potassium", 3.5, 5.0, "mEq/L"), ("calcium", 8.5, 10.5, "mg/dL"), ("iron", 50.0, 175.0, "μg/dL"),
    ("ferritin", 15.0, 400.0, "ng/mL"), ("c reactive protein", 0.0, 10.0, "mg/L"),
]
HEMOGLOBIN_BY_SEX = {"male": (13.0, 17.0), "female": (12.0, 15.5)}
CATEGORIES = [
    ("cbc", ["hemoglobin", "erythrocyte", "leukocyte", "platelet", "hematocrit", "mcv", "mch", "rbc", "wbc"]),
    ("lft", ["bilirubin", "transaminase", "aminotransferase", "phosphatase", "albumin", "globulin", "ggt"]),
    ("kft", ["creatinine", "urea", "uric acid", "gfr"]),
    ("lipid", ["cholesterol", "triglyceride", "hdl", "ldl", "vldl", "lipoprotein"]),
    ("diabetes", ["glucose", "hemoglobin a1c", "insulin"]),
    ("thyroid", ["thyrotropin", "thyroxine", "triiodothyronine", "thyroid"]),
    ("iron_studies", ["iron", "ferritin", "transferrin", "tibc"]),
    ("cardiac", ["troponin", "natriuretic", "ck-mb", "cpk"]),
    ("coagulation", ["prothrombin", "fibrinogen", "d-dimer", "inr", "aptt"]),
    ("vitamins", ["vitamin", "cobalamin", "folate", "calciferol"]),
    ("electrolytes", ["sodium", "potassium", "chloride", "calcium", "phosph", "magnesium", "bicarbonate"]),
]
STOP_WORDS = ["mass", "volume", "moles", "with", "from", "serum", "plasma"]


def holds_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def filter_lab_codes(codes: DataFrame) -> DataFrame:
    """Active quantitative codes of common specimens and properties, with a component. Columns are never null, only ''."""
    return codes.where(
        F.col("STATUS").isin("ACTIVE", "")
        & holds_any(F.lower("SYSTEM"), SYSTEMS)
        & ((F.col("PROPERTY") == "") | F.lower("PROPERTY").isin(PROPERTIES))
        & F.lower("SCALE_TYP").isin("qn", "")
        & (F.trim("COMPONENT") != "")
    )


def is_priority(component: Column, patterns: list[str] | None = None) -> Column:
    return holds_any(F.lower(component), patterns or PRIORITY)


def class_filter(classes: DataFrame, categories: DataFrame | None) -> DataFrame:
    """Only the classes of some categories(category); all of them without a restriction."""
    return classes if categories is None else classes.join(categories.select("category").distinct(), "category", "left_semi")


def attach_reference_ranges(codes: DataFrame, component: str = "COMPONENT", ranges: list[tuple] | None = None, by_sex: dict | None = None) -> DataFrame:
    """Adds normal_min, normal_max, unit and ranges of the first pattern in table order that the component holds.

    An ordered chain of conditions, so no join. Where a pattern fits its unit replaces the code's; else the bounds are null.
    """
    table = REFERENCE_RANGES if ranges is None else ranges
    text = F.lower(component)
    hit = F.lit(None).cast("int")
    for i, row in reversed(list(enumerate(table))):
        hit = F.when(F.contains(text, F.lit(row[0])), i).otherwise(hit)
    entry = lambda k: F.get(F.array(*[F.lit(r[k]) for r in table]), F.col("__hit"))
    sexes = HEMOGLOBIN_BY_SEX if by_sex is None else by_sex
    pairs = [x for k, (lo, hi) in sexes.items() for x in (F.lit(k), F.struct(F.lit(lo).alias("min"), F.lit(hi).alias("max")))]
    old = F.col("unit") if "unit" in codes.columns else F.lit("")
    out = codes.withColumn("__hit", hit)
    separate = F.when(entry(0) == "hemoglobin", F.create_map(*pairs)) if pairs else F.lit(None).cast("map<string,struct<min:double,max:double>>")
    return out.withColumns({"normal_min": entry(1), "normal_max": entry(2), "unit": F.coalesce(entry(3), old), "ranges": separate}).drop("__hit")


def infer_category(component: Column, system: Column, rules: list[tuple] | None = None) -> Column:
    """The first rule that fits; urine specimens come before all rules, `other` after."""
    c, s = F.lower(component), F.lower(system)
    out = F.when(F.contains(s, F.lit("urine")) | (s == "ur"), "urine")
    for name, words in rules or CATEGORIES:
        out = out.when(holds_any(c, words), name)
    return out.otherwise("other")


def build_aliases(component: Column, long_name: Column, key: Column, most: int = 6) -> Column:
    """The component and the longer words of the long name, lower case, without the key: sorted, the first `most`."""
    words = F.filter(F.split(F.lower(long_name), r"(?U)\s+"), lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS))
    return F.slice(F.array_sort(F.array_remove(F.array_union(F.array(F.lower(component)), words), key)), 1, most)


def merge_catalog(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Existing entries stay; new keys come after."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def resolve_lab_catalog(codes: DataFrame, max_tests: int = 300, priority: Column | None = None) -> DataFrame:
    """One row a key of codes(key, row_no, COMPONENT, ...): pos and is_priority, and the other columns of the row that wins.

    In row order, a key that a non-priority row has taken is closed. Until then priority rows replace each
    other, at the place of the first. Non-priority keys keep their first row. All priority keys stay; the
    others fill up to max_tests, and one that is a priority key uses its place all the same. If the priority
    keys exceed max_tests, as many of the others are left off the end.
    """
    first = F.coalesce(priority if priority is not None else is_priority(F.col("COMPONENT")), F.lit(False))
    rows = stored(codes.withColumn("is_priority", first), "codes")  # read several times
    entry = F.struct(*[F.col(c) for c in codes.columns])
    cut = F.min(F.when(~F.col("is_priority"), F.col("row_no")))
    keyed = rows.groupBy("key").agg(cut.alias("cut"))
    joined = rows.join(keyed, "key")
    early = joined.where(F.col("is_priority") & (F.col("cut").isNull() | (F.col("row_no") < F.col("cut"))))
    chosen = early.groupBy("key").agg(F.max_by(entry, "row_no").alias("entry"), F.min("row_no").alias("pos")).withColumn("is_priority", F.lit(True))
    others = rows.where(~F.col("is_priority")).groupBy("key").agg(F.min_by(entry, "row_no").alias("entry"), F.min("row_no").alias("pos"))
    n = chosen.agg(F.count(F.lit(1)).alias("n_priority")).crossJoin(others.agg(F.count(F.lit(1)).alias("n_other")))
    room = F.lit(max_tests) - F.col("n_priority")
    most = F.when(room >= 0, room).otherwise(F.greatest(F.col("n_other") + room, F.lit(0)))
    first_ones = numbered(others, "pos", "key").crossJoin(F.broadcast(n)).where(F.col("no") < most)  # one row of counts
    rest = first_ones.join(chosen.select("key"), "key", "left_anti").select("key", "entry", "pos", F.lit(False).alias("is_priority"))
    own = [c for c in codes.columns if c != "key"]
    return chosen.unionByName(rest).select("key", "pos", "is_priority", *[F.col(f"entry.{c}") for c in own])


def catalog_stats(codes: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows_read, relevant, priority, other, final: what became of a code list."""
    relevant = filter_lab_codes(codes).select(F.lit(1).alias("one"), is_priority(F.col("COMPONENT")).alias("p"))
    counts = relevant.agg(F.count("one").alias("relevant"), F.count_if("p").alias("priority"), F.count_if(~F.col("p")).alias("other"))
    return codes.agg(F.count(F.lit(1)).alias("rows_read")).crossJoin(counts).crossJoin(catalog.agg(F.count(F.lit(1)).alias("final")))


def merge_brands(curated: DataFrame, fetched: DataFrame, drugs: DataFrame) -> DataFrame:
    """drug, aliases: curated(drug, brand, ord) as they are, then fetched ones not seen in any case, then the drug's lower-case name unless seen."""
    names = drugs.select("drug").distinct()
    own = curated.select("drug", F.col("brand").alias("alias"), F.lit(0).alias("src"), F.col("ord").cast("long").alias("ord"))
    more = fetched.select("drug", F.col("brand").alias("alias"), F.lit(1).alias("src"), F.col("ord").cast("long").alias("ord"))
    last = names.select("drug", F.lower("drug").alias("alias"), F.lit(2).alias("src"), F.lit(0).cast("long").alias("ord"))
    rows = own.unionByName(more).unionByName(last).join(names, "drug", "left_semi")
    seen = Window.partitionBy("drug", F.lower("alias")).orderBy("src", "ord")
    kept = rows.withColumn("no", F.row_number().over(seen)).where((F.col("src") == 0) | (F.col("no") == 1))
    return kept.groupBy("drug").agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "ord", "alias"))), lambda r: r["alias"]).alias("aliases"))


def build_drug_catalog(members: DataFrame, brands: DataFrame, indications: DataFrame) -> DataFrame:
    """id, display_name, category, aliases, purpose of members(class_ord, category, member_ord, name): the first class of a key wins.

    brands(drug, aliases) by lower-case name, as merge_brands() gives; indications(name, indication).
    """
    order = Window.partitionBy("id").orderBy("class_ord", "member_ord")
    first = members.withColumn("id", entity_key(F.col("name"), drug=True)).withColumn("no", F.row_number().over(order)).where(F.col("no") == 1)
    b = brands.select(F.lower("drug").alias("__drug"), "aliases")
    i = indications.groupBy(F.lower("name").alias("__name")).agg(F.min("indication").alias("indication"))
    low = F.lower("name")
    joined = first.join(b, low == F.col("__drug"), "left").join(i, low == F.col("__name"), "left")
    purpose = F.nullif(truncate_indication(F.col("indication")), F.lit(""))
    return joined.select("id", title_case(F.col("name")).alias("display_name"), "category", F.coalesce("aliases", F.array(low)).alias("aliases"), purpose.alias("purpose"))


def drug_counts(members: DataFrame) -> DataFrame:
    """unique_keys and duplicates_skipped of the members."""
    key = entity_key(F.col("name"), drug=True)
    return members.agg(F.countDistinct(key).alias("unique_keys"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("duplicates_skipped"))


def alias_pairs(catalog: DataFrame, src: int, skip_metadata: bool) -> DataFrame:
    rows = catalog.where(~F.startswith("id", F.lit("_"))) if skip_metadata else catalog
    rows = rows.select("id", "ord", F.posexplode("aliases").alias("alias_ord", "a"))
    return rows.select(F.lower(F.trim("a")).alias("alias"), "id", F.struct(F.lit(src).alias("src"), F.col("ord").cast("long").alias("ord"), "alias_ord").alias("at")).where(F.col("alias") != "")


def build_synonyms(tests: DataFrame, medicines: DataFrame) -> DataFrame:
    """alias, id: the last entry of an alias wins, medicines after tests; an alias that is its own id is left out."""
    rows = alias_pairs(tests, 0, True).unionByName(alias_pairs(medicines, 1, False)).where(F.col("alias") != F.col("id"))
    return rows.groupBy("alias").agg(F.max_by("id", "at").alias("id"))


def extend_synonyms(existing: DataFrame, catalog: DataFrame) -> DataFrame:
    """existing(alias, id), with aliases that it lacks: the first entry wins. added is true for those, so that they can be counted."""
    first = alias_pairs(catalog, 0, False).groupBy("alias").agg(F.min_by("id", "at").alias("id"))
    new = first.join(existing.select("alias"), "alias", "left_anti")
    return existing.select("alias", "id", F.lit(False).alias("added")).unionByName(new.select("alias", "id", F.lit(True).alias("added")))


def build_unit_map(curated: DataFrame, tests: DataFrame) -> DataFrame:
    """variant, canonical: the curated units, then each catalog unit under its lower-case spelling if that is not there yet."""
    own = tests.where(F.coalesce("unit", F.lit("")) != "").groupBy(F.lower("unit").alias("variant")).agg(F.min_by("unit", "ord").alias("canonical"))
    return curated.select("variant", "canonical").unionByName(own.join(curated.select("variant"), "variant", "left_anti"))
