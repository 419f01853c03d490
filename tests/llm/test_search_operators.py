"""Language ID, similarity join, nearest neighbours, chat formatting, suffix-array dedup and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from conftest_words import languages  # noqa: I001
from pyspark.sql import functions as F

from assayflow.llm import ann, chat, jaccard_join, language_id, suffix_dedup
from assayflow.llm.hashing import shingle_sets
from assayflow.llm.suffix_array import name_order, permuted_prefixes, suffix_array


def test_language_id(spark, odd_docs, no_docs):
    rng = random.Random(6)
    rows = [(i, languages(rng, lang, rng.randrange(5, 90)), lang, "s") for i, lang in enumerate(rng.choice(["aa", "bb", "cc"]) for _ in range(400))]
    mixed = (9000, languages(rng, "aa", 60) + " " + languages(rng, "bb", 20), None, "s")
    odd = [(9001, None, "aa", "s"), (9002, "123 --", "aa", "s"), (9003, "", None, None), (None, rows[0][1], "aa", None)]
    df = spark.createDataFrame([*rows, mixed, *odd], "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash"))
    model = language_id.train(df)
    got = {r["doc_id"]: r for r in language_id.detect(df, model).withColumn("held_out", language_id.held_out(F.col("doc_id"))).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert len(held) > 50 and np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert got[9000]["lang_pred"] == "aa" and {s["lang"] for s in got[9000]["spans"]} >= {"aa", "bb"} and sum(s["words"] for s in got[9000]["spans"]) == 80
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (9001, 9002, 9003)) and got[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.detect(odd_docs, language_id.train(odd_docs)).count() == odd_docs.count()
    empty = language_id.train(no_docs)
    assert empty.labels == [] and {r["lang_pred"] for r in language_id.detect(odd_docs, empty).collect()} == {"und"}


def test_words_are_letters_and_marks(spark):
    assert language_id.words_of("हिन्दी भाषा, ½ ² ① Ⅷ 12 x_y 3D") == ["हिन्दी", "भाषा", "x", "y", "d"]
    assert language_id.words_of("\u0301 ªb µ") == ["ªb", "µ"] and language_id.words_of("½ ² ①") == []
    rng = random.Random(4)
    for _ in range(300):  # the plain pattern says the same where it is taken
        text = "".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(128, 0x250)))) for _ in range(60)).lower()
        assert language_id.PLAIN.findall(text) == language_id.WORD.findall(text) or language_id.OTHER.search(text)
    model = language_id.fit([(lang, languages(rng, lang, 50).split()) for lang in ("aa", "bb") for _ in range(20)])
    docs = spark.createDataFrame([(1, "½ ② 7"), (2, languages(rng, "bb", 30))], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.detect(docs, model).orderBy("doc_id").collect()] == ["und", "bb"]


def test_training_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "DOCS_A_LANGUAGE", 20)
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    one = spark.range(3000).select("id", F.lit("the same words").alias("text"), F.lit("aa").alias("lang"))
    row = spark.range(3000).select(F.lit(8).alias("id"), F.lit("a repeated row").alias("text"), F.lit("bb").alias("lang"))
    rare = spark.range(50).select(F.col("id") + 9000, F.lit("rare").alias("text"), F.lit("cc").alias("lang")).toDF("id", "text", "lang")
    found = language_id.training_sample(one.unionByName(row).unionByName(rare), "id")
    by = defaultdict(list)
    for lang, words in found:
        by[lang].append(words)
    assert len(by["aa"]) == 20 and len(by["bb"]) <= 20 and "cc" not in by and by["aa"][0] == ["the", "same", "words"]


def test_text_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(language_id, "MEMO", 50)
    monkeypatch.setattr(language_id, "BLOCK", 60)
    rng = random.Random(1)
    model = language_id.fit([(lang, languages(rng, lang, 50).split()) for lang in ("aa", "bb") for _ in range(20)])
    texts = [languages(rng, "aa", 400), languages(rng, "bb", 30), None, "", languages(rng, "bb", 300)]
    small, preds = language_id.Labeller(model), []
    for _, own in language_id.blocks(texts):
        preds += [model.labels[p.mean(axis=0).argmax()] if len(p) else None for p in small.posteriors(own)]
    assert preds == ["aa", "bb", None, None, "bb"]


def test_forward_backward():
    rng = np.random.default_rng(2)
    e, t = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    valid = np.array([[True, True, True, False]])
    total, marginal = 0.0, np.zeros((4, 3))
    for a in np.ndindex(3, 3, 3):
        w = np.exp(sum(e[0, i, a[i]] for i in range(3)) + sum(t[a[i], a[i + 1]] for i in range(2)))
        total += w
        for i in range(3):
            marginal[i, a[i]] += w
    post, _, z = language_id.forward_backward(e, t, valid)
    assert np.allclose(post[0, :3], marginal[:3] / total) and np.allclose(z, np.log(total))


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def restated_classes(rows):
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows if r["doc_id"] is not None}
    parent = {i: i for i in sets}

    def find(a):
        return a if parent[a] == a else find(parent[a])

    inverted = defaultdict(list)
    for i, s in sorted(sets.items()):
        common = defaultdict(int)
        for g in s:
            for j in inverted[g]:
                common[j] += 1
            inverted[g].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join(spark, odd_docs, no_docs):
    rng = random.Random(8)
    rows, i = [], 0
    for _ in range(60):  # groups of edits of edits, of all small sizes
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(1, 8)):
            rows.append((i, " ".join(base)))
            i += 1
            if rng.random() < 0.8:
                base[rng.randrange(len(base))] = f"x{rng.randrange(10)}"
            if rng.random() < 0.3:
                base = base + [f"y{rng.randrange(10)}"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sign", F.lit("clash"))
    for docs in (df, odd_docs):
        want = restated_classes(docs.collect())
        for r in jaccard_join.near_duplicate_classes(docs).collect():
            if r["doc_id"] is not None:
                assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
    assert jaccard_join.near_duplicate_classes(no_docs).count() == 0


def test_jaccard_join_of_hot_groups(spark, monkeypatch):
    """A passage in most documents, edits of one text of which few link, no hub among some, and an id with two texts."""
    rng = random.Random(18)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(rng.randrange(5, 60))] + passage)) for i in range(150)]
    for at, edits in ((1000, (0, 1, 2, 3, 4)), (2000, (3, 4, 5, 6))):
        base = [word() for _ in range(120)]
        for i in range(150):
            own = list(base)
            for _ in range(rng.choice(edits)):
                own[rng.randrange(len(own))] = word()
            rows.append((at + i, " ".join(own)))
    rows += [(5000, rows[0][1] + " x"), (5000, rows[160][1] + " y"), (5001, rows[170][1].upper()), (5002, rows[170][1].replace(" ", "\n"))]
    want = restated_classes([{"doc_id": k, "text": t} for k, (_, t) in enumerate(rows)])
    # Each row by itself; then the two rows of 5000 are one document.
    least = {}
    for k, (i, _) in enumerate(rows):
        least[want[k][1]] = min(i, least.get(want[k][1], i))
    one, two = (want[k][1] for k, (i, _) in enumerate(rows) if i == 5000)
    least[one] = least[two] = min(least[one], least[two])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted((i, want[k][0], least[want[k][1]]) for k, (i, _) in enumerate(rows))
    for known, limit in ((10_000, None), (3, 0)):  # few frequent signatures known; and no set small enough to broadcast
        monkeypatch.setattr(jaccard_join, "KNOWN", known)
        if limit is not None:
            monkeypatch.setattr(jaccard_join, "small", lambda d, n: d)
        got = sorted(tuple(r) for r in jaccard_join.near_duplicate_classes(df).select("doc_id", "n_shingles", "component_id").collect())
        assert got == expected


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(5)
    pairs = []
    for trial in range(9000):
        n = int(rng.integers(1, 200)) if trial < 6000 else int(rng.integers(200, 3000)) if trial < 8800 else int(rng.integers(3000, 9000))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        most = n // 4
        gone, new = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
        if trial % 3 == 0:  # as far apart as a link allows
            gone = most * 4 // 5
            new = 0 if trial % 2 else (n - gone) // 4 - gone
        b = np.concatenate([a[: n - gone], rng.integers(0, 1 << 62, max(0, new)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            pairs.append((a, b))
    assert len(pairs) > 3000
    for at in range(0, len(pairs), 100):
        own = pairs[at : at + 100]
        signs = jaccard_join.signatures([x for p in own for x in p])
        assert all(set(x.tolist()) & set(y.tolist()) for x, y in zip(signs[::2], signs[1::2], strict=True))
    alone = jaccard_join.signatures([pairs[0][0], np.empty(0, np.uint64), pairs[0][1]])  # a set's signatures are its own
    assert not len(alone[1]) and sorted(alone[0].tolist()) == sorted(jaccard_join.signatures([pairs[0][0]])[0].tolist())


def test_shingle_sets():
    texts = [b"a b c d e f", b"A  b\tc d E f", b"a b", b"", b" ", b"a b c d e f a b c d e"]
    s = [x.tolist() for x in shingle_sets(texts)]
    assert s[0] == s[1] and [len(x) for x in s] == [2, 2, 1, 0, 0, 6] and set(s[0]) <= set(s[5])


def test_jaccard_join_of_shared_passages(spark, monkeypatch):
    """Texts of 7 out of 12 passages that all share: the classes of brute force, and candidates that grow no faster than the rows by much."""
    rng = random.Random(6)
    some = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passages, counted, stored = [some(40) for _ in range(12)], {}, jaccard_join.stored
    texts = [" ".join(passages[k] for k in sorted(rng.sample(range(12), 7))) + " " + some(rng.randrange(1, 40)) for _ in range(600)]

    def watched(df, name, **options):
        out = stored(df, name, **options)
        counted[name] = out.count() if name in ("jaccard-last", "jaccard-alike") else 0
        return out

    monkeypatch.setattr(jaccard_join, "stored", watched)
    candidates = []
    for n in (300, 600):
        docs = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicate_classes(docs).collect()}
        candidates.append(counted["jaccard-last"])
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts[:n])]
        root = list(range(n))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a in range(n):
            for b in range(a):
                if 100 * len(both := sets[a] & sets[b]) >= 80 * (len(sets[a]) + len(sets[b]) - len(both)):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        assert got == {i: find(i) for i in range(n)}
    assert candidates[1] < 3 * candidates[0] and counted["jaccard-alike"] < 550


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(3000 + i, vectors[7].tolist()) for i in range(500)]
    odd = [(9000, None), (9100, []), (9200, [0.0] * 16), (9300, [float("nan")] * 16), (9400, [None] * 16), (9500, [1.0] * 3), (9600, [float("inf")] * 16), (None, [1.0] * 16), (7, vectors[7].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x, hits = np.array([v for _, v in rows]), []
    assert set(got) == set(range(0, 3500, 100))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert len(found) == 10 and all(s == d[i] for i, s in found) and found == sorted(found, key=lambda f: (f[1], f[0]))
        hits.append(len({i for i, _ in found} & set(np.lexsort((np.arange(len(d)), d))[:10].tolist())) / 10)
    assert np.mean(hits) >= 0.9
    assert got[3000][0][0] == 7 and [i for i, _ in got[3000][1:]] == list(range(3001, 3010))
    assert ann.search(df.limit(0)).count() == 0
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 1)]


def test_nearest_recall_and_repeats(spark):
    """On the driver's vectors, which are as hard as can be: hardly nearer neighbours than the rest."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], np.array(r[1], np.float64)) for r in table.collect() if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = defaultdict(list)
    for r in ann.search(table).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits.append(len({i for _, i in got[q]} & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
    assert np.mean(hits) >= 0.9
    # The share of rows that a query visits falls with their number, so the index saves the more the larger the table.
    # A query whose id is repeated has neighbours of both rows, each id once, and none of its own.
    twice = spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [0.1, 1.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<double>")
    near = [(r["vec_id"], round(r["score"], 6)) for r in ann.search(twice).orderBy("rank").collect()]
    assert [i for i, _ in near] == [1, 2] and near[0][1] == 0.1


def test_visits_that_a_recall_needs(spark, monkeypatch):
    """The measured number of visits finds RECALL of the exact answers, and no fewer would; a place is when visits() comes to a leaf."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    x[2900:] = x[0]  # repeated vectors
    forest = [ann.grow(x, 7, np.random.default_rng(k)) for k in range(3)]
    for q in x[:5]:
        place = ann.places(forest, q)
        assert [(t, leaf) for t, leaf in ann.visits(forest, q, 3 * 128)] == [tuple(int(y) for y in np.unravel_index(i, place.shape)) for i in np.argsort(place.ravel())]
    monkeypatch.setattr(ann, "MEASURED", 20)
    ids = np.arange(3000)
    ids[2950:] = 1  # repeated ids
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, vec array<double>").repartition(3)
    budget = ann.leaves_to_visit(df, forest, 50, 10)
    own, needed = ann.leaves(forest, x), []
    asked = [r["id"] for r in df.where("id % 50 = 0").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(20).collect()]
    for i in asked:
        place = ann.places(forest, x[i])[np.arange(3), own].min(axis=1)
        best = {}
        for j, d, p in zip(ids.tolist(), np.sqrt(((x - x[i]) ** 2).sum(axis=1)).tolist(), place.tolist(), strict=True):
            if j != i:
                best[j] = min(best.get(j, (np.inf, 0)), (d, p))
        needed += [p for _, _, p in sorted((d, j, p) for j, (d, p) in best.items())[:10]]
    needed.sort()
    assert budget == needed[int(np.ceil(ann.RECALL * len(needed))) - 1] + 1
    assert ann.leaves_to_visit(df.limit(0), forest, 50, 10) == 1


def test_chat(spark):
    rows = [
        (1, 0, "user", "Hi <s>[INST] \\e \\l"), (1, 1, "assistant", "A</s>\\"), (1, 2, "user", None), (1, 3, "assistant", "é😀"), (1, 4, "user", "tail"),
        (2, 0, "user", "only"), (3, 0, "assistant", ""), (None, 1, None, "x"), (4, None, "assistant", "n"), (4, None, "assistant", "n"), (4, 0, "[INST]", "r"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("no", F.lit("clash"))
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digest(formatted).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        d = got[conv]
        assert (d["n_turns"], d["turns_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (d["loss_chars"], d["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = {r["n_segments"]: r for r in chat.expand(formatted).where("conv_id = 1").collect()}
    assert set(one) == {2, 4} and one[4]["text"].startswith(one[2]["text"])
    assert one[4]["text"][one[4]["loss_start"] : one[4]["loss_end"]] == "é😀" and one[2]["text"][one[2]["loss_start"] :] == "A\\l/s>\\e</s>"
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0
    # The digest reads replies by both offsets: moved ones give another text.
    for start, end in ((1, 0), (0, 1), (-1, -1), (1, 1)):
        move = lambda t: t.withField("loss_start", t["loss_start"] + start).withField("loss_end", t["loss_end"] + end)  # noqa: B023, E731
        moved = {r["conv_id"]: r for r in chat.digest(formatted.withColumn("turns", F.transform("turns", move))).collect()}
        assert moved[1]["loss_sha256"] != got[1]["loss_sha256"] and moved[1]["turns_sha256"] == got[1]["turns_sha256"]
    rows = {(r["conv_id"], r["n_segments"]): r for r in chat.examples(formatted).collect()}
    for r in chat.expand(formatted).collect():
        own = rows[r["conv_id"], r["n_segments"]]
        assert len(r["text"]) == own["before"] + len(own["segment"]) and r["text"][own["before"] :] == own["segment"]


def test_chat_reads_examples_with_their_whole_texts(spark, monkeypatch):
    """The digest goes through the expanded texts: what is changed in one of them shows in it, a context's length too."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e"), (2, 0, "user", "f"), (3, 0, "assistant", "g")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    own = {r["conv_id"]: r for r in chat.digest(formatted).collect()}
    texts = {(r["conv_id"], r["n_segments"], r["final"]): r["text"] for r in chat.expand_all(formatted).collect()}
    ab, cd, e = "<s>user[INST]a</s><s>assistant[INST]b</s>", "<s>user[INST]c</s><s>assistant[INST]d</s>", "<s>user[INST]e</s>"
    assert texts == {(1, 2, False): ab, (1, 4, True): ab + cd, (1, 5, True): e, (2, 1, True): "<s>user[INST]f</s>", (3, 1, True): "<s>assistant[INST]g</s>"}
    assert own[1]["formatted_chars"] == len(ab + ab + cd + e)
    whole = chat.expand_all
    monkeypatch.setattr(chat, "expand_all", lambda f: whole(f).withColumn("text", F.replace(F.replace("text", F.lit("INST]d"), F.lit("INST]Z")), F.lit("INST]a"), F.lit("INST]aa"))))
    changed = {r["conv_id"]: r for r in chat.digest(formatted).collect()}
    assert changed[2] == own[2] and changed[3] == own[3]
    assert changed[1]["formatted_chars"] == own[1]["formatted_chars"] + 2
    assert changed[1]["turns_sha256"] == hashlib.sha256(b"user\naa\nassistant\nb\nuser\nc\nassistant\nZ\nuser\ne\n").hexdigest()


def test_language_id_reads_whole_runs(spark):
    rng = random.Random(6)
    model = language_id.fit([(lang, languages(rng, lang, 50).split()) for lang in ("aa", "bb") for _ in range(20)])
    runs = {x: languages(rng, x, 400).replace(" ", "") for x in ("aa", "bb")}
    texts = [runs["aa"][:24] + runs["bb"], runs["bb"][:24] + runs["aa"], runs["aa"][:600] + runs["bb"][:600]]
    got = {r["doc_id"]: r for r in language_id.detect(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1)] == ["bb", "aa"] and [s["lang"] for s in got[2]["spans"]] == ["aa", "bb"]
    for n in (1, 23, 24, 25, 48, 49, 1000, 12345):
        run = "".join(rng.choice("abcdefgh") for _ in range(n))
        own = language_id.words_of(run)
        bare = [w.strip("-") for w in own]
        assert bare[0] + "".join(w[2:] for w in bare[1:]) == run and all(len(w) <= 26 for w in bare)
        every, seen = {zlib.crc32(f.encode()) % language_id.BUCKETS for k in (2, 3) for f in (f"^{run}$"[i : i + k] for i in range(n + 3 - k))}, set()
        for w in own:
            seen.update(language_id.features(w, frozenset()))
        assert every | {zlib.crc32(f"s{run}$"[-5:].encode() if n < 3 else f"s{run[-3:]}$".encode()) % language_id.BUCKETS} <= seen
    assert language_id.features("word", frozenset()) == sorted_features("word")


def sorted_features(word):
    w, own = f"^{word}$", {"b"}
    own |= {x for k in (2, 3, 4) for x in ("p" + w[:k], "s" + w[-k:])} | {w[i : i + k] for k in (2, 3) for i in range(len(w) - k + 1)}
    return [zlib.crc32(f.encode()) % language_id.BUCKETS for f in sorted(own)]


def test_training_stretch_of_unspaced_text(spark):
    texts = [f"{chr(0x4E00 + i)}" * 20_000 + f"{chr(0x5E00 + i)}" * 20_000 for i in range(40)]
    docs = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    sample = language_id.training_sample(docs)
    letters = [{c for w in words for c in w if c != "-"} for _, words in sample]
    assert any(min(x) >= chr(0x5E00) for x in letters) and any(max(x) < chr(0x5E00) for x in letters)
    assert all(sum(map(len, words)) <= 1.3 * language_id.CHARS_A_DOCUMENT for _, words in sample)


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for trial in range(150):
        d = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 150))).astype(np.uint8)
        d = np.tile(d, 3) if trial % 3 == 0 else d
        b = d.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert suffix_array(d, len(b) + 1).tolist() == want
        p = permuted_prefixes(d, np.array(want), 100)
        for x, y in zip(want, want[1:], strict=False):
            n = 0
            while n < min(len(b) - max(x, y), 100) and b[x + n] == b[y + n]:
                n += 1
            assert p[y] == n


def restated_removal(rows):
    seen, out = {}, {}
    for i, raw in sorted(rows):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen and seen[w] != (i, p):
                gone[p : p + 100] = True
            seen.setdefault(w, (i, p))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, odd_docs, no_docs):
    rng = random.Random(12)
    passages = ["".join(rng.choice("abc ") for _ in range(rng.randrange(90, 400))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(passages)[rng.randrange(40) :] if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(150))) for _ in range(4))) for i in range(80)]
    rows += [(200, "q" * 500), (201, "q" * 99), (202, None), (203, "ab" * 3000), (204, "é" * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash"))
    want = restated_removal([(i, (t or "").encode()) for i, t in rows])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == want
    unique = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = restated_removal([(r["doc_id"], (r["text"] or "").encode()) for r in unique.collect()])
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(unique).collect()} == want
    assert suffix_dedup.remove_repeats(odd_docs).count() == odd_docs.count() and suffix_dedup.remove_repeats(no_docs).count() == 0


def test_hot_anchor_is_split(spark, monkeypatch):
    rng, bound, firsts = random.Random(4), 6000, suffix_dedup.group_firsts
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line, tails = letters(60), [letters(45) for _ in range(3)]
    rows = [(i, letters(rng.randrange(90, 200)) + line + (rng.choice(tails) if i % 3 == 0 else "") + letters(rng.randrange(90, 200))) for i in range(250)]
    rows += [(1000, line * 5), (1001, rows[3][1][:150] + "é" * 60 + rows[3][1][150:])]

    def bounded(data, position, length):
        assert len(data) <= 2 * bound, f"a shard of {len(data)} bytes"
        return firsts(data, position, length)

    monkeypatch.setattr(suffix_dedup, "SHARD", bound)
    monkeypatch.setattr(suffix_dedup, "group_firsts", bounded)
    rows += [(2000 + i, rows[5][1]) for i in range(30)] + [(3000, "=" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = restated_removal([(i, t.encode()) for i, t in rows])
    assert sum(w[1] > 0 for w in want.values()) > 50
    # No frequent anchors known; some of them known; all known that come more than once; and no set small enough to broadcast.
    for sampled, frequent, limit in ((16, 10**6, None), (4, 8, None), (1, 2, None), (1, 2, 0)):
        monkeypatch.setattr(suffix_dedup, "SAMPLED", sampled)
        monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
        if limit is not None:
            monkeypatch.setattr(suffix_dedup, "small", lambda d, n: d)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df).collect()}
        assert got == want, (sampled, frequent)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = [passage + "x" * 50, "y" + passage[100:700], "z" * 20 + passage]
    for own in suffix_dedup.pieces([t.encode() for t in texts]):
        assert all(len(p) <= 300 + 99 for _, _, p in own)
    places = [(r, a + k) for own in suffix_dedup.pieces([t.encode() for t in texts]) for r, a, p in own for k in range(len(p) - 99)]
    assert sorted(places) == [(r, k) for r, t in enumerate(texts) for k in range(len(t) - 99)]


def test_names_told_apart_are_not_sorted_again(monkeypatch):
    """Only names that are alike so far go into another round, and the order is that of the suffixes as far as depth names count."""
    rng = np.random.default_rng(4)
    names = np.concatenate([rng.permutation(5_000), np.arange(200), rng.permutation(5_000), np.arange(200)])
    sizes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda keys, *a, **k: sizes.append(len(keys)) or sort(keys, *a, **k))
    order = name_order(names, 100)
    monkeypatch.undo()
    text = names.tolist()
    assert [text[i : i + 100] for i in order.tolist()] == sorted(text[i : i + 100] for i in range(len(text)))
    assert sum(sizes) < 3.5 * len(names)
