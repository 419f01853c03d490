"""Fill-in-middle, importance resampling and packing against plain restatements, on odd inputs too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayflow.llm import fill_middle, packing, queries, resample, token_files
from assayflow.sources.shared import shared_path

JSON = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def filled(doc_id, text, seed=7, rate=100, spm=50, unit="line"):
    """n, form, prefix_chars, middle_chars and output, from a list of all units."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd_docs, no_docs):
    more = [(9000, "a\n<S>\nb"), (9001, "\n"), (9002, "\n\n\n"), (9003, "one line"), (9004, "ä\r\n😀\n" * 4000), (9005, "x" * 5000 + "\n" + "é" * 3000), (9006, "<P" + "\n>")]
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).withColumn("form", F.lit("clash"))
    for parameters in ({}, {"unit": "char", "seed": 3, "rate": 60, "spm": 20}):
        done = fill_middle.fill_in_middle(docs, **parameters)
        assert done.columns.count("form") == 1 and "source" in done.columns
        rows = done.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == filled(r["doc_id"], r["text"], **parameters)
            assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in fill_middle.fill_in_middle(docs).collect()} == {"plain", "psm", "spm"}
    assert fill_middle.digest(no_docs).count() == 0


@pytest.mark.parametrize("unit", ["line", "char"])
def test_blocks(unit):
    rng = random.Random(5)
    for size in (1, 3, 64):
        for n in (1, 2, 5, 63, 64, 65, 300):
            text = "".join(rng.choice("ab\né😀") for _ in range(n))
            units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
            blocks = fill_middle.Blocks(np.frombuffer(text.encode(), np.uint8), unit, size)
            assert blocks.units() == len(units)
            for k in range(len(units) + 1):
                assert blocks.cut(k) == (len("".join(units[:k]).encode()), len("".join(units[:k])))


def resampled(docs, target, ngram=1, buckets=10_000, seed=2024, least=20, percent=10):
    """Counter of (doc_id, n_features, weight, score, rank)."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, ngram + 1) for i in range(len(words) - k + 1)]

    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([d[1] for d in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[:8], 16)
        rows.append((words, doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is not None, r[1] or 0, r[2]))
    drawn = may[: percent * len(may) // 100]
    out = Counter((*r[1:], i + 1) for i, r in enumerate(drawn))
    return out + Counter((*r[1:], None) for r in may[len(drawn) :]) + Counter((*r[1:], None) for r in rows if r[0] < least)


def test_resample(spark, odd_docs, no_docs):
    more = [(9000, "wörd " * 30), (9001, "LOUD Word 7"), (9002, "x" * 100 + " " + "漢" * 40), (9003, "y" * 64 + " " + "y" * 65)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).withColumn("score", F.lit("clash"))
    texts = ["the ing tion loud", None, "", "漢" * 40 + " word"]
    target = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for parameters in ({}, {"ngram": 2, "buckets": 50, "seed": 5, "percent": 40, "least": 5}):
        own = {("least_words" if k == "least" else k): v for k, v in parameters.items()}
        got = resample.resample(docs, target, **own).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert Counter(map(tuple, got)) == resampled(plain, texts, **parameters)
    few = spark.createDataFrame([(i, "a b") for i in range(5)], "doc_id long, text string")
    assert {r["rank"] for r in resample.resample(few, target).collect()} == {None}
    assert resample.resample(no_docs, target).count() == 0
    assert resample.resample(few, target.limit(0)).count() == 5


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_resample"])
def test_sql(spark, name):
    """The query has the rows of its SQL on the driver's smallest tables."""
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    other = con.execute(queries.ORACLES[name])
    columns, want = [c[0] for c in other.description], Counter(other.fetchall())
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(columns) and Counter(map(tuple, df.select(*columns).collect())) == want


def test_draw_ties(spark):
    """A score that nearly all rows share is drawn by id, over several ranges."""
    scored = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(30).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), F.when(F.col("id") % 10 == 0, 9).otherwise(5).cast("long").alias("score"))
    got = {r["doc_id"]: r["rank"] for r in resample.draw(scored, percent=50).collect()}
    want = sorted(range(4000), key=lambda i: (i % 10 != 0, i))
    assert got == {i: (k + 1 if k < 2000 else None) for k, i in enumerate(want)}


def test_crcs():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice((1, 2, 2, 7, 63, 64, 65, 200)))) for _ in range(500)]
    assert resample.crcs(words).tolist() == [zlib.crc32(w) for w in words] and resample.crcs([]).tolist() == []


def least_cost(place, penalty, capacity, last):
    cost = {place[0]: 0}
    for p, pen in list(zip(place, penalty, strict=True))[1:]:
        final = p == place[-1] and not last
        cost[p] = min(cost[q] + (0 if final else capacity - (p - q) + pen) for q in cost if p - q <= capacity)
    return cost[place[-1]]


@pytest.mark.parametrize("last", [True, False])
def test_choose_cuts(last):
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.randrange(3, 40)
        place = [0]
        while len(place) < rng.randrange(2, 60):
            place.append(place[-1] + rng.randrange(1, capacity + 1))
        penalty = [rng.choice((0, 0, 2, 10)) for _ in place]
        cuts = packing.choose_cuts(place, penalty, capacity, last)
        assert cuts[0] == 0 and cuts[-1] == place[-1] and set(cuts) <= set(place)
        cost, at = 0, dict(zip(place, penalty, strict=True))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            assert 0 < b - a <= capacity
            cost += 0 if b == place[-1] and not last else capacity - (b - a) + at[b]
        assert cost == least_cost(place, penalty, capacity, last)


def check_packed(pieces, docs, capacity, end_id):
    """Every id of every document in one piece, sequences full from 0 on without a gap, no piece over its end."""
    tok, by_sequence, found = Tokenizer.from_file(JSON), defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r["length"] * 4 == len(r["ids"]) and r["length"] > 0
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        found[r["doc_id"]].append((r["start"], r["doc_tokens"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(by_sequence) == set(range(len(by_sequence)))
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append(tok.encode(text or "", add_special_tokens=False).ids + [end_id])
    assert set(found) == set(want)
    for doc_id, texts in want.items():
        assert sum(len(t) for t in texts) == sum(len(ids) for _, _, ids in found[doc_id])
        if len(texts) == 1:
            rows = sorted(found[doc_id])
            assert [x for _, _, ids in rows for x in ids] == texts[0] and {n for _, n, _ in rows} == {len(texts[0])}
            assert [s for s, _, _ in rows] == np.cumsum([0] + [len(ids) for _, _, ids in rows])[:-1].tolist()
        else:
            assert Counter(n for _, n, ids in found[doc_id] for _ in ids) == Counter(len(t) for t in texts for _ in t)
    return by_sequence


def test_packing(spark, odd_docs, no_docs, monkeypatch):
    docs = odd_docs.withColumn("offset", F.lit("clash"))
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    packed = packing.pack(docs, JSON)
    by_sequence = check_packed(packed.collect(), plain, 2048, 1)
    total = sum(n for spans in by_sequence.values() for _, n in spans)
    assert 2048 * len(by_sequence) - total < 2048 + 0.01 * total
    whole = packing.sequences(packed).collect()
    assert sum(r["n_tokens"] for r in whole) == total and all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)
    assert packing.digest(packed).select(F.sum("length")).first()[0] == total
    assert packing.pack(no_docs, JSON).count() == 0
    check_packed(packing.pack(docs, JSON, capacity=100, end_id=70_000).collect(), plain, 100, 70_000)


def test_packing_blocks():
    """Small blocks give the same pieces in all, whatever is carried from one to the next, and an open end only at the end."""
    rng, ends = random.Random(4), packing.sentence_ends(JSON)
    for open_end in (True, False):
        shard, docs, rows = packing.Shard(0, ends, 64), [], []
        for block in range(6):
            lengths = [rng.randrange(1, 150) for _ in range(rng.randrange(0 if block == 5 else 1, 6))]
            ids = np.array([rng.randrange(50_000) for _ in range(sum(lengths))], np.uint32)
            first = len(docs)
            for n, end in zip(lengths, np.cumsum(lengths).tolist(), strict=True):
                docs.append(ids[end - n : end].tolist())
            rows += shard.rows(packing.Items(ids, list(range(first, len(docs))), [0] * len(lengths), lengths, lengths), block == 5, open_end).to_pylist()
        back, windows = defaultdict(list), defaultdict(int)
        for r in sorted(rows, key=lambda r: r["place"]):
            assert r["start"] == len(back[r["doc_id"]])
            back[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
            windows[r["window"]] += r["length"]
        assert [back[i] for i in range(len(docs))] == docs and max(windows.values()) <= 64
        assert (None in windows) == open_end and set(windows) - {None} == set(range(len(windows) - open_end))


def test_token_files_of_bounded_size(spark, odd_docs):
    """Shards end at a number of ids, and the offsets go on over all of them."""
    docs = odd_docs.where("length(text) < 2000").select("doc_id", "text")
    folder = shared_path(spark, "bounded")
    manifest = token_files.write_token_files(docs, folder, JSON, shard_ids=500)
    longest = max(r["n_tokens"] for r in token_files.token_digest(docs, JSON).collect())
    shards = manifest.collect()
    assert len(shards) > 4 and max(r["n_tokens"] for r in shards) < 500 + longest
    key = lambda r: (r["start"], r["n_tokens"], r["ids_crc32"])
    assert sorted(map(key, token_files.read_token_files(manifest, folder).collect())) == sorted(map(key, token_files.token_digest(docs, JSON).collect()))
