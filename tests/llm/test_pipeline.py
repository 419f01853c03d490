"""The pipeline against a brute-force version of each stage's decisions."""

import os
import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from conftest_words import SYLLABLES, languages
from pyspark.sql import functions as F
from test_search_operators import restated_classes
from test_text_operators import restated_targets

from assayflow.llm import bpe, language_id
from assayflow.llm.common import stored
from assayflow.sources import shared


def test_stages(spark):
    docs, columns = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), corpus_pipeline.COLUMNS
    docs = docs.unionByName(spark.createDataFrame([(90001, None, "en", "src0", 0), (90002, "12 --", None, "src0", 5)], docs.schema)).withColumn("extra", F.lit(1))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], ""), name))
    start, language, lines, near, mixed, tokens = seen
    assert all(d.columns == columns for d in seen[1:-1])
    assert {r["doc_id"] for r in start.collect()} - {r["doc_id"] for r in language.collect()} == {90001, 90002}
    assert lines.count() == language.count()
    want = restated_classes(lines.collect())
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    sizes, taken = {}, {}
    for r in near.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    longest = max(len(r["text"].split()) for r in near.collect())
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in restated_targets(sizes).items())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert tokens.count() == mixed.count() and all(r["ids"] == enc.encode_ordinary(texts[r["doc_id"]]) for r in tokens.collect())


def test_documents_of_several_languages_stay(spark):
    rng = random.Random(2)
    rows = [(i, languages(rng, lang, 60), lang, "s", 0) for lang in SYLLABLES for i in range(100 * ord(lang[0]), 100 * ord(lang[0]) + 90)]
    rows += [(i, " ".join(languages(rng, lang, 64) for lang in SYLLABLES), None, "s", 0) for i in range(20)] + [(50, None, "aa", "s", 0), (51, "12 --", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r for r in language_id.detect(docs, language_id.train(docs)).collect()}
    assert all(r["score"] <= r["certainty"] + 1e-9 and r["certainty"] <= 1 for r in found.values())
    assert any(found[i]["score"] < corpus_pipeline.MIN_CERTAINTY for i in range(20)) and found[50]["certainty"] == 0
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {50, 51}


def test_without_labels(spark):
    rows = [(1, "plain words", None), (2, None, None), (3, "12 --", None), (4, "中文", None), (None, "no id", "en")]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["text"], r["lang"]) for r in corpus_pipeline.language(spark, docs, "").collect()) == [("no id", "en"), ("plain words", "und"), ("中文", "und")]


def test_near_duplicates_of_odd_ids(spark):
    """A row without id stays; of the rows of one id one stays, whatever their order; copies of any of its texts are its copies."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (2, texts[2]), (3, texts[2] + " x"), (4, texts[3]), (None, texts[3]), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(n, "text"), "").collect()), key=str) for n in (1, 4)]
    assert kept[0] == kept[1] and [i for i, _ in kept[0]] == [1, 2, 4, 5, None]


def test_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), name)
    assert docs.count() == 0


def test_run_leaves_its_stages_alone(spark, tmp_path):
    """run() gives the rows of its stages, and of all that it wrote only the stages' results are still there."""
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).write.parquet(str(tmp_path / "documents.parquet"))
    made = len(shared._made)
    got = sorted((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [os.path.basename(p).rsplit("-", 1)[0] for p in shared._made[made:] if os.path.isdir(p.removeprefix("file://"))]
    assert names == [f"pipeline-{n}" for n, _ in corpus_pipeline.STAGES[:-1]]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), name)
    assert got == sorted((r["doc_id"], r["decoded_sha256"]) for r in docs.collect())
