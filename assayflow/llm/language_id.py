"""Language identification by a linear-chain conditional random field that labels words.

Words are chained in stretches of whole texts; a run of more than PIECE letters (text without spaces) is
several chained words that together have all its letters. Each word has affix, n-gram and lexicon features, and
learned transitions tie neighbours, so that a text that switches language is labelled piece by piece by
forward-backward. A document's language is the label with the largest mean posterior over its words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.llm.common import kept
from assayflow.llm.hashing import CRC_TABLE

#: Training bounds: languages, labelled documents a language, and words and characters of one document (a stretch at a hashed place).
LANGUAGES, DOCS_A_LANGUAGE, WORDS_A_DOCUMENT = 200, 800, 192
CHARS_A_DOCUMENT = 40 * WORDS_A_DOCUMENT
#: Letters of a word at most; what stands at the end of one that goes on in the next, and at the start of that.
PIECE, SEAM = 24, "-"
#: Words of a chain; buckets of hashed features; least count of a word in the lexicon; passes over the sample.
CHAIN, BUCKETS, LEXICON_LEAST, EPOCHS = 64, 1 << 16, 3, 3
#: Words a worker remembers and words it labels at a time.
MEMO, BLOCK = 250_000, 100_000
#: Words whose features are made at a time.
ROWS = 2_048
#: Letters and the marks on them. Texts without characters above Latin letters take the plain pattern, which says the same there.
WORD, PLAIN, OTHER = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*"), re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ]+"), re.compile("[^\x00-ɏ]")
UNKNOWN = "und"


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    transitions: np.ndarray  # labels x labels, log
    lexicon: frozenset


def cut_runs(runs: list[str]) -> list[str]:
    """Runs of letters as words: a longer run than PIECE is cut into even pieces, each after the first with the two letters before it."""
    if not runs or max(map(len, runs)) <= PIECE:
        return runs
    out = []
    for run in runs:
        n = -(-len(run) // PIECE)
        at = [len(run) * i // n for i in range(n + 1)]
        for i in range(n):
            out.append((SEAM if i else "") + run[max(0, at[i] - 2) : at[i + 1]] + (SEAM if i + 1 < n else ""))
    return out


def words_of(text: str) -> list[str]:
    text = text.lower()
    return cut_runs((WORD if OTHER.search(text) else PLAIN).findall(text))


def step(crc: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """CRC-32 registers after one more character each, which counts as its UTF-8 bytes."""

    def after(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return CRC_TABLE[(crc ^ byte) & 0xFF] ^ (crc >> 8)

    out, wide = after(crc, chars), chars >= 0x80
    if wide.any():
        chars, crc = chars[wide], crc[wide]
        crc = after(crc, np.where(chars < 0x800, 0xC0 | chars >> 6, np.where(chars < 0x10000, 0xE0 | chars >> 12, 0xF0 | chars >> 18)))
        for shift, least in ((12, 0x10000), (6, 0x800), (0, 0x80)):
            more = chars >= least
            crc[more] = after(crc[more], 0x80 | chars[more] >> shift & 0x3F)
        out[wide] = crc
    return out


def packed(a: np.ndarray | int, b: np.ndarray | int, c: np.ndarray | int = 0, more: int = 0) -> np.ndarray:
    """Keys in the order of strings by their first three characters (letters and marks have 20 bits), then by what follows."""
    return np.asarray(a << 42 | b << 22 | c << 2 | more)


def rows_of(words: list[str], lexicon: frozenset) -> np.ndarray:
    """A row of features for each of some words of one length, all or none with a seam before them, and after them.

    Columns of characters update the CRCs of all words at once. Rows are in the order of their features' strings; what a word has twice or not at all is BUCKETS.
    """
    first, last = words[0][0] != SEAM, words[0][-1] != SEAM
    text = "".join([("^" if first else "") + w.strip(SEAM) + ("$" if last else "") for w in words])
    char = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    size, c = char.shape[1], char.astype(np.int64)
    two = step(step(np.full(char.shape, ~np.uint32(0)), char)[:, :-1], char[:, 1:])
    found = [(packed(ord("b"), 0), np.full((len(words), 1), ~np.uint32(zlib.crc32(b"b"))))]
    found += [(packed(c[:, :-1], c[:, 1:]), two), (packed(c[:, :-2], c[:, 1:-1], c[:, 2:]), step(two[:, :-1], char[:, 2:]))]
    crc = np.full((len(words), 1), ~np.uint32(zlib.crc32(b"p^")))
    for k in range(2, min(4, size) + 1):
        if first:
            crc = step(crc, char[:, k - 1 : k])
            found.append((packed(ord("p"), ord("^"), c[:, 1:2], k - 2), crc))
        if last:
            end = np.full((len(words), 1), ~np.uint32(zlib.crc32(b"s")))
            for i in range(size - k, size):
                end = step(end, char[:, i : i + 1])
            found.append((packed(ord("s"), c[:, size - k, None], c[:, size - k + 1, None], k - 2), end))
    known = np.array([w in lexicon for w in words])
    whole = np.array([[zlib.crc32(f"w{w}".encode()) if k else 0] for w, k in zip(words, known.tolist(), strict=True)], np.uint32)
    found.append((packed(ord("w"), *((c[:, 1:2], c[:, 2:3]) if first else (ord(SEAM), c[:, :1])), 3), ~whole))
    key = np.concatenate([np.broadcast_to(k, crc.shape) for k, crc in found], axis=1)
    rows = (~np.concatenate([crc for _, crc in found], axis=1) % BUCKETS).astype(np.int64)
    rows[~known, -1] = BUCKETS
    order = np.argsort(key, axis=1)
    key, rows = np.take_along_axis(key, order, 1), np.take_along_axis(rows, order, 1)
    rows[:, 1:][key[:, 1:] == key[:, :-1]] = BUCKETS
    return rows


def feature_rows(words: list[str], lexicon: frozenset) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of words: prefixes, suffixes, n-grams of 2 and 3 with word ends, and the word if the lexicon has it.

    A piece has prefixes only at its run's start and suffixes only at its run's end; its n-grams go over the seam before it.
    Gives places in `words` and the rows of features there, for at most ROWS words at a time.
    """
    shapes: dict[tuple, list[int]] = {}
    for i, w in enumerate(words):
        shapes.setdefault((len(w), w[0] != SEAM, w[-1] != SEAM), []).append(i)
    for places in shapes.values():
        for at in range(0, len(places), ROWS):
            own = places[at : at + ROWS]
            yield np.array(own), rows_of([words[i] for i in own], lexicon)


def features(word: str, lexicon: frozenset) -> list[int]:
    """Hashed features of one word."""
    return [f for f in rows_of([word], lexicon)[0].tolist() if f < BUCKETS]


def forward_backward(emission: np.ndarray, transitions: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of chains.

    emission: chains x words x labels (log); valid: chains x words, true up to each chain's end.
    Returns the posteriors of labels, the summed posteriors of neighbouring label pairs, and the log of Z.
    """
    n, size, k = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    e[~valid] = 1.0
    t = np.exp(transitions)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((n, size))
    for i in range(size):
        a = e[:, i] if i == 0 else (alpha[:, i - 1] @ t) * e[:, i]
        s = a.sum(axis=1)
        on = valid[:, i]
        if i and not on.all():
            a[~on], s[~on] = alpha[~on, i - 1], 1.0
        scale[:, i] = s
        alpha[:, i] = a / s[:, None]
    pairs = np.zeros((k, k))
    for i in range(size - 2, -1, -1):
        nxt = beta[:, i + 1] * e[:, i + 1] / scale[:, i + 1][:, None]
        on = valid[:, i + 1]
        beta[:, i] = np.where(on[:, None], nxt @ t.T, 1.0)
        pairs += t * (alpha[on, i].T @ nxt[on])
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    z = (np.log(scale) * valid).sum(axis=1) + (emission.max(axis=2) * valid).sum(axis=1)
    return post, pairs, z


def fit(samples: list[tuple[str, list[str]]]) -> Model:
    """Fit by AdaGrad on (label, words) samples; a third of the chains join two of them, so that switches are learned too."""
    labels = sorted({x for x, _ in samples})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), frozenset())
    at, k, rng = {x: i for i, x in enumerate(labels)}, len(labels), np.random.default_rng(7)
    counts: dict[str, int] = {}
    for _, words in samples:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    lexicon = frozenset(w for w, c in counts.items() if c >= LEXICON_LEAST)
    ids = {w: i for i, w in enumerate(counts)}
    feats = [np.empty(0, np.int64)] * len(ids)
    for places, rows in feature_rows(list(ids), lexicon):
        for i, row in zip(places.tolist(), rows, strict=True):
            feats[i] = row[row < BUCKETS]
    starts = np.concatenate([[0], np.cumsum([len(f) for f in feats])])
    flat = np.concatenate([np.empty(0, np.int64), *feats])
    pieces = [(at[x], [ids[w] for w in words[i : i + CHAIN]]) for x, words in samples for i in range(0, len(words), CHAIN)]
    rng.shuffle(pieces)
    chains, i = [], 0
    while i < len(pieces):
        x, words = pieces[i]
        if i % 3 == 0 and i + 1 < len(pieces):
            y, more = pieces[i + 1]
            half = CHAIN // 2
            chains.append(([x] * len(words[:half]) + [y] * len(more[:half]), words[:half] + more[:half]))
            if words[half:]:
                chains.append(([x] * len(words[half:]), words[half:]))
            if more[half:]:
                chains.append(([y] * len(more[half:]), more[half:]))
            i += 2
        else:
            chains.append(([x] * len(words), words))
            i += 1
    weights, trans = np.zeros((BUCKETS, k)), np.zeros((k, k))
    g_w, g_t = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for a in range(0, len(order), 128):
            own = [chains[j] for j in order[a : a + 128]]
            size = max(len(w) for _, w in own)
            word, gold = np.zeros((len(own), size), np.int64), np.full((len(own), size), -1)
            for r, (ys, ws) in enumerate(own):
                word[r, : len(ws)], gold[r, : len(ws)] = ws, ys
            valid = gold >= 0
            distinct, where = np.unique(word[valid], return_inverse=True)
            spans = [np.arange(starts[d], starts[d + 1]) for d in distinct]
            rows = flat[np.concatenate(spans)]
            owner = np.repeat(np.arange(len(distinct)), [len(s) for s in spans])
            score = np.stack([np.bincount(owner, weights[rows, x], len(distinct)) for x in range(k)], axis=1)
            emission = np.zeros((*word.shape, k))
            emission[valid] = score[where]
            post, pairs, _ = forward_backward(emission, trans, valid)
            diff = -post[valid]
            diff[np.arange(len(diff)), gold[valid]] += 1.0
            by_word = np.stack([np.bincount(where, diff[:, x], len(distinct)) for x in range(k)], axis=1)
            grad = np.stack([np.bincount(rows, by_word[owner, x], BUCKETS) for x in range(k)], axis=1) / len(own) - 1e-6 * weights
            both = valid[:, 1:]
            t_grad = (np.bincount((gold[:, :-1] * k + gold[:, 1:])[both], minlength=k * k).reshape(k, k) - pairs) / len(own)
            g_w += grad**2
            g_t += t_grad**2
            weights += 0.3 * grad / np.sqrt(g_w)
            trans += 0.1 * t_grad / np.sqrt(g_t)
    return Model(labels, weights.astype(np.float32), trans, lexicon)


class Labeller:
    """A model at work: remembers the scores of words it has met, up to a bound that does not change results."""

    def __init__(self, model: Model):
        self.model, self.memo, self.scores = model, {}, np.empty((MEMO + BLOCK, len(model.labels)), np.float32)
        self.weights = np.concatenate([model.weights, np.zeros((1, len(model.labels)), np.float32)])  # BUCKETS: no feature

    def ids(self, words: list[str]) -> list[int]:
        memo = self.memo
        found = list(map(memo.get, words))
        missing = [at for at, i in enumerate(found) if i is None]
        if missing:
            new, n = list(dict.fromkeys([words[at] for at in missing])), len(memo)
            for places, rows in feature_rows(new, self.model.lexicon):
                first, *others = np.ascontiguousarray(rows.T)
                total = self.weights.take(first, axis=0)
                for column in others:
                    total += self.weights.take(column, axis=0)
                self.scores[n + places] = total
            memo.update(zip(new, range(n, n + len(new)), strict=True))
            for at in missing:
                found[at] = memo[words[at]]
        return found

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Words x labels for each list of words."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        lengths = [len(t) for t in texts]
        if len(self.memo) + sum(lengths) > len(self.scores):  # a text of more words than a block
            self.scores = np.concatenate([self.scores, np.empty((sum(lengths), len(self.model.labels)), np.float32)])
        ids = np.array(self.ids([w for t in texts for w in t]), np.int64)
        chains = np.array([min(CHAIN, n - i) for n in lengths for i in range(0, n, CHAIN)], np.int64)
        if not len(chains):
            return [np.empty((0, len(self.model.labels)), np.float32) for _ in texts]
        valid = np.arange(chains.max()) < chains[:, None]
        emission = np.zeros((*valid.shape, len(self.model.labels)), np.float32)
        emission[valid] = self.scores[ids]
        post = forward_backward(emission, self.model.transitions.astype(np.float32), valid)[0][valid]
        return np.split(post, np.cumsum(lengths)[:-1])


def blocks(texts: pa.Array | list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """The texts' lower-case words, in blocks of about BLOCK words; one longer text is one block."""
    start, own, n = 0, [], 0
    for k, text in enumerate(texts):
        own.append(words_of((text.as_py() if isinstance(text, pa.Scalar) else text) or ""))
        n += len(own[-1])
        if n >= BLOCK or k == len(texts) - 1:
            yield start, own
            start, own, n = k + 1, [], 0


def held_out(id_col: Column) -> Column:
    """Documents kept from training: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, list[str]]]:
    """At most DOCS_A_LANGUAGE documents of each of the LANGUAGES most frequent languages, by hash of id and text, and WORDS_A_DOCUMENT words of each.

    The stretch of a long text starts at a hashed place: first one of CHARS_A_DOCUMENT characters, which may cut
    the words at its ends, then one of words in it. Rows without id, text or language teach nothing.
    """
    usable = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = usable.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return []
    h = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text)), F.lit(1 << 30))
    share = F.lit(0)
    for name, n in sorted((r["lang"], r["n"]) for r in counts):
        share = F.when(F.col(lang) == name, int(min(1.0, (1.2 * DOCS_A_LANGUAGE + 20) / n) * (1 << 30))).otherwise(share)
    spare = F.greatest(F.length(text) - CHARS_A_DOCUMENT, F.lit(0))
    place = F.pmod(F.xxhash64(F.lit("place"), F.col(text)), spare + 1).cast("int") + 1
    words = F.split(F.substring(F.col(text), place, F.lit(CHARS_A_DOCUMENT)), r"\s+")
    start = F.pmod(F.xxhash64(F.lit("start"), F.col(text)), F.greatest(F.size(words) - WORDS_A_DOCUMENT, F.lit(1))).cast("int") + 1
    rows = usable.where(h < share).select(F.col(lang).alias("lang"), F.array_join(F.slice(words, start, F.lit(WORDS_A_DOCUMENT)), " ").alias("t"), h.alias("h"))
    # Rows that repeat id and text pass the hash together, so the bound is held by number as well.
    number = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    rows = rows.withColumn("number", number).where(F.col("number") <= DOCS_A_LANGUAGE)
    found = [(r["lang"], words_of(r["t"])) for r in rows.collect()]
    return sorted(x for x in found if x[1])


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    return fit(training_sample(docs, id_col, text, lang))


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (the label's mean posterior), certainty (the mean of each word's largest posterior) and spans,
    the runs of words (pieces of long runs count) of one language.

    A text of several languages has a low score and yet a high certainty. `und` with score and certainty 0 if the text is null or has no letters, or if nothing was learned. Of equal languages
    the first by code point. Columns of those names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "certainty", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels floats
    schema = docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("lang_pred", "string"), ("score", "double"), ("certainty", "double"), ("spans", "array<struct<lang:string,first_word:int,words:int>>"))]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        model = shared.value
        own, fields = kept(("labeller", id(model)), lambda: Labeller(model)), to_arrow_schema(schema)
        labels = np.array(own.model.labels, object)
        for batch in batches:
            for start, texts in blocks(batch.column(text)):
                preds, scores, sure, spans = [], [], [], []
                for post in own.posteriors(texts) if len(labels) else [np.empty((0, 0))] * len(texts):
                    if not len(post):
                        preds.append(UNKNOWN)
                        scores.append(0.0)
                        sure.append(0.0)
                        spans.append([])
                        continue
                    mean = post.mean(axis=0, dtype=np.float64)
                    best = int(mean.argmax())
                    preds.append(labels[best])
                    scores.append(float(min(1.0, mean[best])))
                    word = post.argmax(axis=1)
                    sure.append(float(min(1.0, post[np.arange(len(post)), word].mean(dtype=np.float64))))
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1, [len(word)]])
                    spans.append([{"lang": labels[word[a]], "first_word": int(a), "words": int(b - a)} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                part = batch.slice(start, len(texts))
                new = [pa.array(v, fields.field(n).type) for n, v in (("lang_pred", preds), ("score", scores), ("certainty", sure), ("spans", spans))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema=fields)

    return docs.mapInArrow(run, schema)
