"""Line dedup, token files, BPE, GIF and mixing against plain restatements, on odd inputs too."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayflow.llm import ann, bpe, gif, line_dedup, mixing, token_files
from assayflow.llm.pieces import Memory, splitter
from assayflow.sources.shared import shared_path

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def test_line_dedup(spark, odd_docs, no_docs):
    rows = [(i, "a", f"boiler\n unique {i} \n\n") for i in range(10)] + [(100 + i, "b", "boiler\nother") for i in range(3)] + [(200, None, "boiler"), (201, "a", None), (202, "a", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("host", F.lit("clash"))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, max_ratio=0.5, min_pages=5).collect()}
    assert got[1]["text"] == " unique 1 \n\n" and (got[1]["n_lines"], got[1]["n_dropped"]) == (4, 1) and got[1]["host"] == "clash"
    assert got[100]["text"] == "boiler\nother" and got[200]["text"] == "boiler" and got[201]["text"] is None and got[202]["text"] == ""
    assert line_dedup.dedup_lines(odd_docs).count() == odd_docs.count()
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_token_files(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(spark.createDataFrame([(5000, "a <|endoftext|> b")], "doc_id long, text string"), allowMissingColumns=True)
    tok = Tokenizer.from_file(JSON)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"])):
        ids = tok.encode(r["text"], add_special_tokens=False).ids + [0]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.token_digest(docs, JSON).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_digest(no_docs, JSON).count() == 0
    # Another kind of tokenizer, with a normalizer and another pre-tokenizer, gets whole texts.
    other = public_tokenizers.path("word_bpe_49k.json")
    assert token_files.piece_pattern(JSON) and token_files.piece_pattern(other) is None
    tok, want = Tokenizer.from_file(other), Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digest(docs, other).collect()) == want
    folder = shared_path(spark, "widths")
    manifest = token_files.write_token_files(docs, folder, JSON, end_id=70_000)
    assert {r["width"] for r in manifest.collect()} == {4} and token_files.read_token_files(manifest, folder).count() == docs.count()


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe(spark, odd_docs, no_docs):
    enc = encoding()
    encoded = bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN)
    for r in bpe.decode(encoded, RANKS).collect():
        assert r["ids"] == enc.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    assert encoded.columns.count("ids") == 1 and bpe.encode(no_docs, RANKS).count() == 0
    odd = spark.createDataFrame([(1, None, "old"), (2, [], "old"), (3, [0, 255, 50255, 198], "old")], "i long, ids array<int>, decoded string")
    pieces = {r: p for p, r in bpe.load_ranks(RANKS).items()}
    assert [r["decoded"] and bytes(r["decoded"]) for r in bpe.decode(odd, RANKS).orderBy("i").collect()] == [None, b"", pieces[0] + pieces[255] + pieces[50255] + pieces[198]]
    assert "InArrow" not in bpe.decode(odd, RANKS)._jdf.queryExecution().optimizedPlan().nodeName()
    for bad in (60_000, -1, -2):
        with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
            bpe.decode(spark.createDataFrame([([bad],)], "ids array<int>"), RANKS).collect()


def test_bpe_pieces(spark):
    rng, enc, ranks = random.Random(2), encoding(), bpe.load_ranks(RANKS)
    odd = ["".join(rng.choice(" \t\n\x0b\x1c\x1f\x85\xa0ab'sé²½٣中😀_-. ") for _ in range(rng.randrange(60))) for _ in range(500)]
    odd += ["a" * 5000, "ab " * 2000, "=" * 3000, " " * 999] + ["".join(rng.choice("abc") for _ in range(300)) for _ in range(50)]
    split = splitter(public_tokenizers.PATTERN)
    memory = Memory(lambda new: [np.array(bpe.fold(p.encode(), ranks), "<i4").tobytes() for p in new], bound=50)
    for t in odd:
        assert np.frombuffer(bpe.encode_texts([t], split, memory)[0], "<i4").tolist() == enc.encode_ordinary(t)
    pieces = spark.createDataFrame([(p,) for p in sorted({x for t in odd[:40] for x in split(t)} | {" theing", "tionär"})], "piece string")
    for r in bpe.encode_pieces_native(pieces, RANKS).collect():
        assert r["ids"] == enc.encode_ordinary(r["piece"])


def test_gif_documents(odd_docs, no_docs):
    media = gif.store_texts(odd_docs)
    want = Counter()
    for r in odd_docs.collect():
        raw = (r["text"] or "").encode()
        full = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        want[(r["doc_id"], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))] += 1
    got = gif.describe(media).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    texts = {}
    for r in odd_docs.where("doc_id IS NOT NULL").collect():
        raw = (r["text"] or "").encode()
        texts[r["doc_id"]] = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
    for r in gif.describe(media).where("doc_id IS NOT NULL").collect():  # each frame shows its rows over those of the frame before
        full, shown, total = texts[r["doc_id"]], b"", Counter()
        size = 576 * min(64, len(full) // 576)
        frames = [full[k : k + 576 * 64] for k in range(0, len(full), 576 * 64)]
        assert [(f["delay_ms"], f["left"], f["top"], f["width"], f["height"]) for f in r["frames"]] == [(40, 0, 0, 576, len(f) // 576) for f in frames]
        for f, own in zip(r["frames"], frames, strict=True):
            shown = own + shown[len(own) : size]
            want_bins = Counter((b >> 6) * 21 for b in shown)
            assert f["histogram"] == [want_bins[i] for i in range(64)]
            total += want_bins
        colours = ",".join(f"{i}:{total[i] * 1000 // total.total()}" for i in sorted(total))
        assert r["feature"] == f"frames={len(frames)};ms={40 * len(frames)};colours={colours}"
    clash = media.withColumns({"media": F.lit(None).cast("binary"), "frames": F.lit("old"), "payload_bytes": F.lit("old"), "kept": F.lit(1)})
    null = gif.describe(clash)
    assert null.columns.count("frames") == 1 and null.columns.count("payload_bytes") == 1
    assert {(r["payload_bytes"], r["media_sha256"], r["frames"], r["feature"], r["kept"]) for r in null.collect()} == {(None, None, None, None, 1)}
    assert gif.frames_of(media.withColumn("frames", F.lit("old"))).columns.count("frames") == 1
    none = gif.frames_of(media.withColumn("media", F.lit(None).cast("binary"))).first()
    assert none["frames"] is None and gif.frames_of(media).where("doc_id = 58").first()["frames"]
    assert gif.describe(gif.store_texts(no_docs)).count() == 0


def test_gif_rules():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def frame(samples, box, disposal, clear=None, interlace=False):
        codes = [4, *[c for s in samples for c in (s, 4)], 5]  # a clear code after each sample: all codes have 3 bits
        bits = "".join(format(c, "03b")[::-1] for c in codes)
        stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        control = bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), 7, 0, clear or 0, 0])
        return control + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in box) + bytes([64 if interlace else 0, 2, len(stream)]) + stream + b"\0"

    head = b"GIF89a" + (2).to_bytes(2, "little") * 2 + b"\x91\0\0" + palette
    data = head + frame([1, 1, 1, 1], (0, 0, 2, 2), 1) + frame([2, 3], (0, 0, 2, 1), 2, clear=3) + frame([3], (1, 1, 1, 1), 3) + frame([0], (0, 1, 1, 1), 1) + b"\x3b"
    f = gif.read_gif(data)
    red, green, blue, black, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 255], [0, 0, 0, 0]
    assert f[0].canvas.tolist() == [[red, red], [red, red]] and f[0].delay == 7
    assert f[1].canvas.tolist() == [[green, red], [red, red]]
    assert f[2].canvas.tolist() == [[none, none], [red, blue]]
    assert f[3].canvas.tolist() == [[none, none], [black, red]]
    tall = b"GIF89a" + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + b"\x91\0\0" + palette + frame([0, 1, 2, 2, 3, 3, 3, 3], (0, 0, 1, 8), 0, interlace=True) + b"\x3b"
    assert gif.read_gif(tall)[0].canvas[:, 0, :3].tolist() == [list(palette[3 * i : 3 * i + 3]) for i in (0, 3, 2, 3, 1, 3, 2, 3)]
    rng = random.Random(1)
    for size in (576, 576 * 64, 576 * 65, 576 * 200):
        samples = bytes(rng.choice(b"abcde\xff") if size % 5 else rng.randrange(256) for _ in range(size))
        assert gif.payload(gif.read_gif(gif.write_gif(samples))) == samples


def restated_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3 * sizes[s] if over else rate * weight[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    return target


def test_mixing(spark, odd_docs, no_docs):
    rng = random.Random(4)
    rows = [(i, f"s{min(rng.randrange(12), 6)}" if i % 50 else None, "w " * rng.randrange(1, 40)) for i in range(3000)]
    rows += [(5000, "z", None), (5001, "tiny", "one two")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    got = {r["doc_id"]: r for r in mixing.mix_sources(df).collect()}
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    target, taken = restated_targets(sizes), defaultdict(int)
    for i, s, t in rows:
        r = got[i]
        assert r["size"] == len((t or "").split()) and r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in sizes)
    assert sorted(map(tuple, mixing.mix_sources(df).collect())) == sorted(map(tuple, got.values()))
    assert mixing.mix_sources(odd_docs).count() == odd_docs.count() and mixing.mix_sources(no_docs).count() == 0


def test_without_broadcasts(spark, odd_docs, monkeypatch):
    """Where no table is small enough to be broadcast, joins are shuffled and the results are the same."""
    rows = [(i, "a" if i % 3 else None, f"boiler\n line {i % 7} \nunique {i}") for i in range(60)] + [(100, "b", "boiler"), (101, "c", None)]
    pages = spark.createDataFrame(rows, "doc_id long, source string, text string")
    vectors = spark.createDataFrame([(i, [float(i % 13), float(i % 7), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    runs = {
        line_dedup: lambda: line_dedup.dedup_lines(pages, max_ratio=0.1, min_pages=5).select("doc_id", "n_lines", "n_dropped", "text"),
        mixing: lambda: mixing.mix_sources(pages),
        ann: lambda: ann.search(vectors),
    }
    for module, run in runs.items():
        want = sorted(map(tuple, run().collect()), key=str)
        monkeypatch.setattr(module, "small", lambda d, max_rows=0: d)
        assert sorted(map(tuple, run().collect()), key=str) == want and want
