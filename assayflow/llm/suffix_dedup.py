"""Suffix-array dedup: remove every byte of a long string that also starts earlier in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.llm.common import small, stored
from assayflow.llm.hashing import BLOCK, byte_sums, mix, span_hashes
from assayflow.llm.suffix_array import Spans, group_firsts

#: Bytes of a repeated string; bytes of the gram that anchors it; bytes of text in a shard's suffix array, about (twice that at most).
LENGTH, GRAM, SHARD = 100, 24, 1 << 20
_POSITION_BITS = 26
#: Documents of which one is sampled for frequent anchors, how many segments make an anchor one, how many are kept, and to how many tasks one is dealt.
SAMPLED, FREQUENT, KNOWN, SPREAD = 16, 64, 10_000, 64


def anchors(starts: np.ndarray, grams: np.ndarray, width: int) -> np.ndarray:
    """For each start, where the least of the `width` grams from there on stands, the leftmost of equal ones.

    Least values of any stretch of `width` come from running minima of blocks, forwards and backwards.
    """
    key = grams >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(key) // width)
    padded = np.full(rows * width, ~np.uint64(0))
    padded[: len(key)] = key
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(block, axis=1).ravel()
    least = np.minimum(ahead[starts], behind[starts + width - 1])
    return (least & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) in blocks of about BLOCK bytes; a longer text is cut into overlapping pieces with each start in one."""
    own, n = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
            part = text[at : at + BLOCK + LENGTH - 1]
            own.append((row, at, part))
            n += len(part)
            if n >= BLOCK:
                yield own
                own, n = [], 0
    if own:
        yield own


SEGMENT = "anchor long, segment long, doc_id long, h long, lo int, n int"


def segments(docs: DataFrame) -> DataFrame:
    """docs(doc_id, h, text) -> runs of starts of LENGTH-byte strings that choose the same anchor.

    Equal strings choose equal anchors, so all places of a repeated string are in segments of one anchor.
    anchor and segment are hashes of the gram and of the segment's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = LENGTH - GRAM + 1
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            ids, hs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h"))
            for own in pieces(texts):
                data = np.frombuffer(b"".join(p for _, _, p in own), np.uint8)
                size = np.array([len(p) for _, _, p in own])
                if len(data) < LENGTH:
                    continue
                begin = np.cumsum(size) - size
                piece = np.repeat(np.arange(len(own)), size)
                starts = np.flatnonzero(np.arange(len(data)) + LENGTH <= (begin + size)[piece])
                if not len(starts):
                    continue
                sums = byte_sums(data)
                at = np.arange(len(data) - GRAM + 1)
                grams = span_hashes(sums, at, at + GRAM)
                chosen = anchors(starts, grams, width)
                cut = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(piece[starts], prepend=-1) != 0))
                lo = starts[cut]
                n = np.diff(np.append(cut, len(starts)))
                row, offset = np.array([r for r, _, _ in own])[piece[lo]], np.array([a for _, a, _ in own])[piece[lo]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[chosen[cut]].view(np.int64)),
                        pa.array(span_hashes(sums, lo, lo + n + LENGTH - 1).view(np.int64)),
                        pa.array(ids[row]),
                        pa.array(hs[row]),
                        pa.array((lo - begin[piece[lo]] + offset).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    names=["anchor", "segment", "doc_id", "h", "lo", "n"],
                )

    return docs.mapInArrow(run, SEGMENT)


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            out: dict[str, list] = {"anchor": [], "doc_id": [], "h": [], "lo": [], "n": [], "bytes": []}
            for doc, h, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text", "wanted")), strict=True):
                raw = text.encode()
                for w in wanted:
                    for name, value in (("anchor", w["anchor"]), ("doc_id", doc), ("h", h), ("lo", w["lo"]), ("n", w["n"]), ("bytes", raw[w["lo"] : w["lo"] + w["n"] + LENGTH - 1])):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())]))


def cut_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, h, text, wanted) -> the wanted segments with their bytes."""
    return docs.mapInArrow(cut_batches, "anchor long, doc_id long, h long, lo int, n int, bytes binary")


def sorted_shards(cut: DataFrame) -> DataFrame:
    """Ranges of starts of strings that also start earlier, from suffix arrays of shards that hold whole anchors, of SHARD bytes at most each."""

    def shard(own: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(x[5] for x in own), np.uint8)
        size = np.array([len(x[5]) for x in own])
        begin = np.cumsum(size) - size
        n = np.array([x[4] for x in own])
        keys = {k: i for i, k in enumerate(sorted({(x[1], x[2]) for x in own}))}
        base = np.array([(keys[x[1], x[2]] << 32) + x[3] for x in own])
        spread = np.repeat(np.arange(len(own)), n)
        inner = np.arange(len(spread)) - np.repeat(np.cumsum(n) - n, n)
        position = np.full(len(data), -1, np.int64)
        place = begin[spread] + inner
        position[place] = base[spread] + inner
        late = group_firsts(data, position, LENGTH)[place]
        turn = np.flatnonzero(late & ~(np.append(False, late[:-1]) & (np.diff(spread, prepend=-1) == 0)))
        last = np.flatnonzero(late & ~(np.append(late[1:], False) & (np.diff(spread, append=-1) == 0)))
        which = spread[turn]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([own[i][1] for i in which.tolist()], pa.int64()),
                pa.array([own[i][2] for i in which.tolist()], pa.int64()),
                pa.array([own[i][3] for i in which.tolist()] + inner[turn], pa.int32()) if len(turn) else pa.array([], pa.int32()),
                pa.array((last - turn + 1).astype(np.int32)),
            ],
            names=["doc_id", "h", "lo", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = [], 0
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "h", "lo", "n", "bytes")), strict=True):
                if held >= SHARD and x[0] != own[-1][0]:
                    yield shard(own)
                    own, held = [], 0
                own.append(x)
                held += len(x[5])
        if own:
            yield shard(own)

    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, h long, lo int, n int")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, h, text, wanted) -> ranges of starts of strings that also start earlier, of anchors with too many differing segments for one shard.

    Each string of LENGTH bytes is a row by itself, with two 64-bit hashes of its bytes, by which equal strings
    meet: N strings have one wrong pair with odds of N * N / 2^129. What is summed up are first places, so a string
    may be in any share of the rows; the starts of a segment that are no first ones are its ranges. Texts are cut in
    the same Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in cut_batches(batches):
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                texts = batch.column("bytes").to_pylist()
                data = np.frombuffer(b"".join(texts), np.uint8)
                n = batch.column("n").to_numpy()
                size = np.array([len(x) for x in texts])
                spread = np.repeat(np.arange(len(n)), n)
                inner = np.arange(len(spread)) - np.repeat(np.cumsum(n) - n, n)
                at = (np.cumsum(size) - size)[spread] + inner
                h1 = span_hashes(byte_sums(data), at, at + LENGTH)
                h2 = mix(Spans(data.astype(np.int64) + 1).of(at, at + LENGTH))
                own = [pa.array(batch.column(c).to_numpy()[spread]) for c in ("anchor", "doc_id", "h")]
                lo = pa.array((batch.column("lo").to_numpy()[spread] + inner).astype(np.int32))
                yield pa.RecordBatch.from_arrays([own[0], pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), own[1], own[2], lo], names=["anchor", "h1", "h2", "doc_id", "h", "lo"])

    starts = docs.mapInArrow(run, "anchor long, h1 long, h2 long, doc_id long, h long, lo int")
    first = starts.groupBy("anchor", "h1", "h2").agg(F.min(F.struct("doc_id", "h", "lo")).alias("first"))
    firsts = stored(first.groupBy("first.doc_id", "first.h").agg(F.collect_list("first.lo").alias("firsts")), "suffix-firsts")

    def ranges(w: Column) -> Column:
        """Runs of a segment's starts that are no first ones."""
        again = F.array_except(F.sequence(w["lo"], w["lo"] + w["n"] - 1), F.coalesce("firsts", F.array().cast("array<int>")))
        inner = F.array(again)
        begins = F.flatten(F.transform(inner, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1) != x - 1))))
        ends = F.flatten(F.transform(inner, lambda a: F.filter(a, lambda x, i: (i == F.size(a) - 1) | (F.get(a, i + 1) != x + 1))))
        return F.zip_with(begins, ends, lambda x, y: F.struct(x.alias("lo"), (y - x + 1).alias("n")))

    own = docs.select("doc_id", "h", "wanted").join(firsts, ["doc_id", "h"], "left")
    return own.select("doc_id", "h", F.inline(F.flatten(F.transform("wanted", ranges))))


def later(places: DataFrame, *key: str) -> DataFrame:
    """Those of places(doc_id, h, lo) that have an earlier one of the same key. A key may have any share of the rows: its first place is
    summed up before a shuffle, and as a stored table it can be joined back in parts."""
    place = F.struct("doc_id", "h", "lo")
    first = places.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("several")).where(F.col("several") > 1)
    return places.join(stored(first.drop("several"), "suffix-first"), list(key)).where(place != F.col("first")).drop("first")


def frequent_anchors(docs: DataFrame) -> DataFrame:
    """anchor, often: anchors of which a sample of the documents has many segments, KNOWN of them at most. They decide where rows go, not which."""
    sample = segments(docs.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(SAMPLED)) == 0))
    often = sample.groupBy("anchor").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") >= FREQUENT)
    return stored(often.orderBy(F.desc("often"), "anchor").limit(KNOWN), "suffix-often")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """docs(doc_id, h, text) -> doc_id, h, lo, n: starts of LENGTH-byte strings that also start earlier.

    Segments equal in all bytes (by 64-bit hashes of segment and anchor) are one class: all but the earliest repeat
    it whole. Only the earliest of each class goes on, and only where an anchor has several classes; there the
    suffix arrays find the strings that differing segments share, or, where those of an anchor are more than
    SHARD bytes, hashes of each string in a shuffle. Segments of a frequent anchor are dealt to SPREAD tasks,
    and its classes are found by sums.
    """
    often = frequent_anchors(docs)
    place = F.struct("doc_id", "h", "lo")
    task = F.when(F.col("often").isNotNull(), F.pmod(F.xxhash64(place), F.lit(SPREAD))).otherwise(0).cast("int")
    marked = segments(docs).join(F.broadcast(often), "anchor", "left").withColumn("task", task)
    anchor, same = Window.partitionBy("anchor", "task"), Window.partitionBy("anchor", "task", "segment")
    marked = marked.withColumns({"first": F.min(place).over(same), "least": F.min("segment").over(anchor), "most": F.max("segment").over(anchor)})
    marked = marked.withColumns({"spread": F.col("often").isNotNull(), "repeats": place != F.col("first")}).where(F.col("spread") | F.col("repeats") | (F.col("least") != F.col("most")))
    size = F.sum(F.when(~F.col("repeats"), F.col("n").cast("long") + LENGTH - 1)).over(anchor)
    marked = marked.withColumn("hot", F.coalesce(size > SHARD, F.lit(False)))
    marked = stored(marked.select("anchor", "segment", "doc_id", "h", "lo", "n", "repeats", "hot", "spread"), "suffix-marked")

    def with_wanted(own: DataFrame) -> DataFrame:
        wanted = own.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "lo", "n")).alias("wanted"))
        wanted = stored(wanted, "suffix-wanted")
        few = docs.join(small(wanted.select("doc_id", "h"), 300_000), ["doc_id", "h"], "left_semi")
        return few.join(wanted, ["doc_id", "h"])

    dealt, spread = marked.where(~F.col("spread")), marked.where("spread")
    found = [dealt.where("repeats").select("doc_id", "h", "lo", "n")]
    hot = dealt.where(~F.col("repeats") & F.col("hot")).select("anchor", "doc_id", "h", "lo", "n")
    cold = dealt.where(~F.col("repeats") & ~F.col("hot")).select("anchor", "doc_id", "h", "lo", "n")
    if not often.isEmpty():
        # Each task has found the first of its own; those of all tasks meet here.
        found.append(spread.where("repeats").select("doc_id", "h", "lo", "n"))
        each = stored(spread.where(~F.col("repeats")).select("anchor", "segment", "doc_id", "h", "lo", "n"), "suffix-each")
        found.append(later(each, "anchor", "segment").select("doc_id", "h", "lo", "n"))
        firsts = each.groupBy("anchor", "segment").agg(F.min(F.struct("doc_id", "h", "lo", "n")).alias("first")).select("anchor", "first.*")
        size = firsts.groupBy("anchor").agg(F.sum(F.col("n").cast("long") + LENGTH - 1).alias("size"), F.count(F.lit(1)).alias("several")).where(F.col("several") > 1)
        firsts = firsts.join(stored(size, "suffix-sizes"), "anchor")
        hot, cold = (x.unionByName(firsts.where(c).select("anchor", "doc_id", "h", "lo", "n")) for x, c in ((hot, F.col("size") > SHARD), (cold, F.col("size") <= SHARD)))
    found.append(sorted_shards(cut_texts(with_wanted(cold))))
    hot = stored(hot, "suffix-hot")
    if not hot.isEmpty():
        found.append(repeated_starts(with_wanted(hot)))
    return stored(reduce(DataFrame.unionByName, found), "suffix-ranges")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that stay.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or
    earlier in the same document; strings are taken from the input. Null texts are empty; null ids come
    first; rows that repeat id and text are one document; of an id with two texts, the one with the
    smaller hash is earlier. Texts shorter than LENGTH stay whole.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranges = repeated_ranges(rows).distinct().groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("lo", "n"))).alias("ranges"))
    joined = rows.join(ranges, ["doc_id", "h"], "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
                for text, own in zip(batch.column("text").to_pylist(), batch.column("ranges"), strict=True):
                    raw, kept, spans, at = text.encode(), [], 0, 0
                    if own.is_valid:
                        fields = own.values
                        end = -1
                        for lo, n in zip(fields.field("lo").to_pylist(), fields.field("n").to_pylist(), strict=True):
                            if lo > end:
                                kept.append(raw[at:lo] if end >= 0 else raw[:lo])
                                spans += 1
                            end = max(end, lo + n + LENGTH - 1)
                            at = end
                    kept.append(raw[at:])
                    rest = b"".join(kept)
                    for name, value in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(rest)), ("n_spans", spans), ("kept_sha256", hashlib.sha256(rest).hexdigest()), ("kept", rest)):
                        out[name].append(value)
                new = pa.RecordBatch.from_pydict(out, schema=pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *new.columns], names=["doc_id", *new.schema.names])

    out = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != lowest, F.col("doc_id")))
