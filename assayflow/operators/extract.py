"""Measurements and entities found in text against curated catalogs."""

from __future__ import annotations

import pickle
import re
from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.functions.text import filled, normalize_text, normalize_unit, parse_number
from assayflow.sources.shared import read_block, small, stored, write_blocks

#: Fixed value: what follows a name - a separator, a number, perhaps a unit.
VALUE = r"\s*[:\-]?\s*(\d[\d,]*\.?\d*)\s*([a-zA-Z/%^\d]+)?"
#: Aliases of an automaton at most, automata that a worker holds, and bytes of texts that meet each automaton in turn where there are more.
ALIASES, HELD, BUFFER = 100_000, 4, 1 << 24
_automata: OrderedDict = OrderedDict()


def alias_rows(catalog: DataFrame) -> DataFrame:
    """id, ord, name, alias, alias_ord, units, normal_min, normal_max of catalog(id, ord, display_name, aliases, ...).

    The display name comes before the aliases; equal ones stay. Optional columns: unit, units, ranges
    (map of min and max), normal_min, normal_max. A bound of 0 in `all` or `male` counts as missing.
    """
    have = set(catalog.columns)
    opt = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    name = F.coalesce(filled("display_name"), F.col("id"))
    unit = F.coalesce(opt("unit", "string"), F.lit(""))
    units = F.coalesce(opt("units", "array<string>"), F.when(unit != "", F.array(unit)).otherwise(F.array().cast("array<string>")))
    ranges = opt("ranges", "map<string,struct<min:double,max:double>>")
    own = F.coalesce(F.try_element_at(ranges, F.lit("all")), F.try_element_at(ranges, F.lit("male")))
    bound = lambda k, c: F.coalesce(filled(own[k].cast("double"), 0.0), opt(c, "double").cast("double"))
    aliases = F.transform(F.concat(F.array(name), F.coalesce(opt("aliases", "array<string>"), F.array().cast("array<string>"))), lambda a: F.lower(a))
    rows = catalog.select("id", "ord", name.alias("name"), units.alias("units"), bound("min", "normal_min").alias("normal_min"), bound("max", "normal_max").alias("normal_max"), F.posexplode(aliases).alias("alias_ord", "alias"))
    return rows.where(F.col("alias") != "")


def tests_by_alias(catalog: DataFrame, units: DataFrame) -> DataFrame:
    """alias, id, name, normal_min, normal_max, test_ord, alias_ord, measured (has the test units?) and own_unit of a catalog, stored, so that a catalog is made once for all that reads it."""
    measured = F.size("units") > 0
    rows = alias_rows(catalog).withColumn("own_raw", F.when(measured, F.get("units", F.lit(0))).otherwise(""))
    rows = normalize_unit(rows, units, "own_raw", "own_unit")
    return stored(rows.select("alias", "id", "name", "normal_min", "normal_max", F.col("ord").alias("test_ord"), "alias_ord", measured.alias("measured"), "own_unit"), "tests")


def alias_shards(aliases: DataFrame) -> tuple[str, int]:
    """The aliases of tests_by_alias() or of a catalog as stored automata: the path in the shared folder and how many there are, none of more than about ALIASES.

    Aliases are dealt by hash; a task makes the automaton of a shard. None of them passes through the driver.
    """
    distinct = (aliases if "alias" in aliases.columns else alias_rows(aliases)).select("alias").distinct()
    n = -(-distinct.count() // ALIASES)

    def build(table: pa.Table) -> pa.Table:
        finder = ahocorasick.Automaton()
        for name in table.column("alias").to_pylist():
            finder.add_word(name, name)
        finder.make_automaton()
        return pa.table({"shard": table.column("shard").slice(0, 1), "automaton": pa.array([pickle.dumps(finder)], pa.binary())})

    sharded = distinct.withColumn("shard", F.pmod(F.xxhash64("alias"), F.lit(max(1, n))).cast("int"))
    return write_blocks(sharded.groupBy("shard").applyInArrow(build, "shard int, automaton binary"), "shard", max(1, n), "aliases"), n


def automaton(path: str, shard: int) -> ahocorasick.Automaton | None:
    """In a task: one of the stored automata, kept by the worker among the last HELD."""
    key = (path, shard)
    if key not in _automata:
        block = read_block(path, "shard", shard)
        while len(_automata) >= HELD:
            _automata.popitem(last=False)
        _automata[key] = pickle.loads(block.column("automaton")[0].as_py()) if block is not None else None
    _automata.move_to_end(key)
    return _automata[key]


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def value_matches(docs: DataFrame, shards: tuple[str, int], strict: bool = False) -> DataFrame:
    """doc_id, alias, match_no, raw, captured: every alias in docs(doc_id, text) with a number after it.

    A text is read once and meets every automaton of alias_shards(), which finds all its aliases in one pass. Matches of one alias
    don't overlap: the next one starts after the number and the unit of the one before.
    """
    path, n = shards
    schema = docs.select("doc_id", F.lit("").alias("alias"), F.lit(0).alias("match_no"), F.lit("").alias("raw"), F.lit("").alias("captured")).schema

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        some, size = [], 0
        for batch in batches:
            some.append(batch)
            size += batch.nbytes
            if n <= HELD or size >= BUFFER:
                yield some
                some, size = [], 0
        if some:
            yield some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = re.compile(VALUE, re.IGNORECASE)
        for some in grouped(batches):
            for shard in range(n):
                finder = automaton(path, shard)
                for batch in some if finder else ():
                    rows, names, numbers, raws, units = [], [], [], [], []
                    for k, text in enumerate(batch.column("text").to_pylist()):
                        seen, at, m = {}, -1, None
                        for last, name in finder.iter(text or ""):
                            start = last + 1 - len(name)
                            end, number = seen.get(name, (0, 0))
                            if start < end or strict and (start > 0 and _in_word(text[start - 1])) == _in_word(text[start]):
                                continue
                            if last != at:  # names that end together have one number
                                at, m = last, value.match(text, last + 1)
                            if m:
                                seen[name] = (m.end(), number + 1)
                                rows.append(k)
                                names.append(name)
                                numbers.append(number)
                                raws.append(m[1])
                                units.append(m[2] or "")
                    columns = [pa.array(x, t) for x, t in ((names, pa.string()), (numbers, pa.int32()), (raws, pa.string()), (units, pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *columns], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_tests(found: DataFrame, aliases: DataFrame, *key: str, few: int = 20_000) -> DataFrame:
    """doc_id, id, name, value, unit, normal_min, normal_max, test_ord, alias_ord, match_no: measured_matches() with a row for each of the tests_by_alias() of equal key.

    Few tests are sent as one list a key, which is spread out about three times as fast as a hash table gives rows of equal keys; more are joined as rows.
    """
    key = key or ("alias",)
    if aliases.limit(few + 1).count() > few:
        rows = found.join(aliases, list(key))
    else:
        lists = aliases.groupBy(*key).agg(F.collect_list(F.struct(*[c for c in aliases.columns if c not in key])).alias("__tests"))
        rows = found.join(F.broadcast(lists), list(key)).select(*found.columns, F.inline("__tests"))
    unit = F.coalesce(F.when(F.col("measured"), F.col("found_unit")), "own_unit")
    return rows.select("doc_id", "id", "name", "value", unit.alias("unit"), "normal_min", "normal_max", "test_ord", "alias_ord", "match_no")


def measured_matches(docs: DataFrame, shards: tuple[str, int], units: DataFrame, strict: bool = False) -> DataFrame:
    """doc_id, alias, match_no, value, found_unit: what value_matches() finds in normalized texts, with number and unit read, once a match and not once a test."""
    found = value_matches(docs.select("doc_id", normalize_text(F.col("text")).alias("text")), shards, strict)
    found = found.select("doc_id", "alias", "match_no", parse_number(F.col("raw")).alias("value"), filled("captured").alias("captured"))
    return normalize_unit(found, units, "captured", "found_unit").drop("captured")


def extract_measurements(docs: DataFrame, catalog: DataFrame, units: DataFrame, strict: bool = False, shards: tuple[str, int] | None = None) -> DataFrame:
    """doc_id, id, name, value, unit, normal_min, normal_max, test_ord, alias_ord, match_no for docs(doc_id, text).

    Every occurrence of a name or alias with a number after it. Names match inside words, a unit may be the
    next word, and a test without units drops a captured one; strict=True asks for word bounds and known units.
    Equal names of one test emit twice. The aliases are searched as stored automata, those in shards (alias_shards() of the same
    catalog, for many calls) or made for this one, and only what is found is joined with their tests.
    """
    aliases = tests_by_alias(catalog, units)
    found = with_tests(measured_matches(docs, shards or alias_shards(aliases), units, strict), aliases)
    if strict:
        found = found.join(small(units.select(F.lower("canonical").alias("__known")).distinct()), F.lower("unit") == F.col("__known"), "left_semi")
    return found


def extract_entities(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """doc_id, id, name, category, first_pos, ord: entities of catalog(id, ord, display_name, category, aliases) named in docs(doc_id, text).

    Tokens of four or more of a-z, 0-9 and hyphens are looked up among ids and lower-case aliases, which are counted before
    they are broadcast: one row a document and entity, at its first token. Partial counts come before the shuffle, so common tokens don't skew it.
    White space is left as it is, since no token has any.
    """
    tokens = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b[a-z0-9\-]{4,}\b"), F.lit(0))).alias("pos", "token"))
    names = F.array_distinct(F.concat(F.array("id"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a))))
    lookup = catalog.select("id", "ord", F.coalesce(filled("display_name"), F.col("id")).alias("name"), "category", F.explode(names).alias("token"))
    hits = tokens.join(small(lookup), "token")
    return hits.groupBy("doc_id", "id", "name", "category", "ord").agg(F.min("pos").alias("first_pos"))


def parse_documents(docs: DataFrame, tests: DataFrame, medicines: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, tests, medicines: what each document holds, in order; both lists empty if nothing is found."""
    m = extract_measurements(docs, tests, units)
    in_order = lambda *order, payload: F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*payload).alias("x")))), lambda r: r["x"])
    m = m.groupBy("doc_id").agg(in_order("test_ord", "alias_ord", "match_no", payload=("id", "name", "value", "unit", "normal_min", "normal_max")).alias("tests"))
    e = extract_entities(docs, medicines).groupBy("doc_id").agg(in_order("first_pos", "ord", payload=("id", "name", "category")).alias("medicines"))
    none = lambda df, c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))
    return docs.select("doc_id").join(m, "doc_id", "left").join(e, "doc_id", "left").select("doc_id", none(m, "tests").alias("tests"), none(e, "medicines").alias("medicines"))
