"""Packing documents into sequences of a bounded number of tokens, in order, by dynamic programming over places to cut."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayflow.llm.common import small, stored
from assayflow.llm.token_files import encoder, tokenizer

#: Production parameters: tokens of a sequence, and the id after each document.
CAPACITY, END_ID = 2048, 1
#: What a cut costs, in tokens of padding: after a sentence, and inside one. After a document it is free.
SENTENCE, INSIDE = 2, 10
#: A stretch of more tokens than this without a sentence's end may be cut at every so many of them.
STRETCH = 16
#: Tokens that are cut at a time (and one document more), and shards whose last, unfilled sequences are packed again together.
BLOCK, SHARDS = 1 << 20, 1024
PIECES = "shard long, place long, window long, doc_id long, start long, length long, doc_tokens long, offset long, ids binary"
_SCHEMA = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in (f.split()[0] for f in PIECES.split(", "))])
_ends: dict = {}


def choose_cuts(place: list[int], penalty: list[int], capacity: int, last: bool = True) -> list[int]:
    """The cuts, from place[0] to the end, of least padding and penalties together, none further than capacity from the next.

    place ascends, by capacity at most from one to the next. The cost up to a place is the least, over all
    places within capacity before it, of (cost there + place there), and what depends on the place itself:
    a queue of ascending values holds the candidates, so all is found in one pass. Without `last`, the final
    window is one to be packed on: its padding doesn't count.
    """
    back, key, queue = [0] * len(place), [place[0]] * len(place), deque([0])
    for j in range(1, len(place)):
        p = place[j]
        while p - place[queue[0]] > capacity:
            queue.popleft()
        i = queue[0]
        back[j], k = i, key[i] + capacity + penalty[j]
        key[j] = k
        while queue and key[queue[-1]] > k:
            queue.pop()
        queue.append(j)
    end = len(place) - 1
    if not last and end:
        first = bisect_left(place, place[end] - capacity)
        back[end] = min(range(first, end), key=lambda i: (key[i] - place[i], i))
    cuts, j = [place[end]], end
    while j:
        j = back[j]
        cuts.append(place[j])
    return cuts[::-1]


def sentence_ends(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By token id: does it end a line, does it end with a sentence's mark, does it begin with white space."""
    if path not in _ends:
        tok = tokenizer(path)
        said = tok.decode_batch([[i] for i in range(tok.get_vocab_size())], skip_special_tokens=False)
        _ends[path] = tuple(np.array(x, bool) for x in (["\n" in s for s in said], [s.rstrip("\"')]”’").endswith((".", "!", "?", "…", "。", "！", "？")) for s in said], [s[:1].isspace() for s in said]))
    return _ends[path]


@dataclass
class Items:
    """Documents, or what is left of them, in order: the ids of all, and of each its id, tokens before it, tokens of the whole document and tokens here."""

    ids: np.ndarray
    doc_id: list
    start: list[int]
    tokens: list[int]
    length: list[int]

    @classmethod
    def none(cls) -> Items:
        return cls(np.empty(0, np.uint32), [], [], [], [])

    def plus(self, o: Items) -> Items:
        return Items(np.concatenate([self.ids, o.ids]), self.doc_id + o.doc_id, self.start + o.start, self.tokens + o.tokens, self.length + o.length)


def places(items: Items, ends: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Where items may be cut, and what it costs: after each item, after each sentence, and in stretches without one."""
    line, mark, opens = ends
    stop = np.cumsum(items.length)
    n = int(stop[-1])
    known = np.minimum(items.ids, len(line) - 1)  # an end id may lie beyond the vocabulary; it is the last of its item anyway
    sentence = line[known]
    sentence[:-1] |= mark[known[:-1]] & opens[known[1:]]
    cost = np.full(n + 1, -1, np.int64)
    cost[np.flatnonzero(sentence) + 1] = SENTENCE
    cost[stop] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    gap = np.diff(at)
    wide = np.flatnonzero(gap > STRETCH)
    more = (gap[wide] - 1) // STRETCH
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    cost[np.repeat(at[wide], more) + nth * STRETCH] = INSIDE
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def pack_items(items: Items, ends: tuple, capacity: int, last: bool) -> tuple[list[int], list[tuple]]:
    """The cuts of the items, and their pieces (window, item, from, to): an item is cut wherever a window ends in it."""
    at, cost = places(items, ends)
    cuts = np.array(choose_cuts(at.tolist(), cost.tolist(), capacity, last))
    stop = np.cumsum(items.length)
    edge = np.unique(np.concatenate([cuts, stop]))
    a, b = edge[:-1], edge[1:]
    return cuts.tolist(), list(zip((np.searchsorted(cuts, a, "right") - 1).tolist(), np.searchsorted(stop, a, "right").tolist(), a.tolist(), b.tolist(), strict=True))


class Shard:
    """Packs items as they come, a block at a time; what the last window of a block holds goes on to the next one."""

    def __init__(self, shard: int, ends: tuple, capacity: int):
        self.shard, self.ends, self.capacity = shard, ends, capacity
        self.window = self.place = 0
        self.rest = Items.none()

    def rows(self, items: Items, last: bool, open_end: bool) -> pa.RecordBatch:
        """The pieces of all windows that are done: all but the last one, which is kept; at the end all, the last without a number if it is open."""
        items = self.rest.plus(items)
        self.rest, out = Items.none(), []
        if items.length:
            cuts, pieces = pack_items(items, self.ends, self.capacity, last and not open_end)
            begin = np.concatenate([[0], np.cumsum(items.length)]).tolist()
            final, kept = len(cuts) - 2, []
            for w, i, a, b in pieces:
                row = (items.doc_id[i], items.start[i] + a - begin[i], items.tokens[i], b - a)
                if w == final and not last:
                    kept.append(row)
                    continue
                number = None if w == final and open_end else self.window + w
                out.append((self.shard, self.place, number, row[0], row[1], row[3], row[2], a - cuts[w], items.ids[a:b].astype("<u4").tobytes()))
                self.place += 1
            self.window += final + (last and not open_end)
            if not last:
                self.rest = Items(items.ids[cuts[-2] :], *[list(x) for x in zip(*kept, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids of each piece, as a stored table.

    Every text is encoded whole, with end_id after it; its pieces lie one after the other, each in the sequence sequence_id at
    offset, and ids has the piece's ids as little-endian 32-bit integers. Documents are packed in the order in
    which a task reads them, so no text is shuffled; a window ends after a document for nothing, after a sentence or
    inside one at a price (choose_cuts). What a task has left at its end, less than a sequence, is packed again
    together with what its neighbours have left, SHARDS tasks at a time; so one sequence in some thousands is open.
    A null text is empty and has end_id alone; null and repeated ids are documents of their own; other columns play
    no part; an empty table gives no piece. Memory holds a block of tokens and one document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = encoder(tokenizer_path), sentence_ends(tokenizer_path)
        shard, items, waiting = Shard(TaskContext.get().partitionId(), ends, capacity), [], 0

        def all_items() -> Items:
            ids = [np.append(own, np.uint32(end_id)) for _, own in items]
            lengths = [len(x) for x in ids]
            return Items(np.concatenate(ids) if ids else np.empty(0, np.uint32), [d for d, _ in items], [0] * len(ids), lengths, lengths)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, own in encode(batch.column("text")):
                for k, tokens in enumerate(own):
                    items.append((doc_ids[at + k], tokens))
                    waiting += len(tokens) + 1
                    if waiting >= BLOCK:
                        yield shard.rows(all_items(), False, True)
                        items, waiting = [], 0
        yield shard.rows(all_items(), True, True)

    def again(table: pa.Table) -> pa.Table:
        table = table.sort_by([("shard", "ascending"), ("place", "ascending")])
        ids = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("ids")]
        column = lambda c: table.column(c).to_pylist()
        items = Items(np.concatenate(ids), column("doc_id"), column("start"), column("doc_tokens"), column("length"))
        group = Shard(-1 - column("shard")[0] // SHARDS, sentence_ends(tokenizer_path), capacity)
        return pa.Table.from_batches([group.rows(items, True, False)])

    packed = stored(rows.mapInArrow(first, PIECES), "packing", compression="zstd")
    left = packed.where(F.col("window").isNull()).groupBy(F.expr(f"shard div {SHARDS}")).applyInArrow(again, PIECES)
    whole = packed.where(F.col("window").isNotNull()).unionByName(stored(left, "packing-left", compression="zstd"))
    sizes = whole.groupBy("shard").agg((F.max("window") + 1).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    bases = stored(sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-bases")
    return whole.join(small(bases), "shard").select("doc_id", "start", "length", "doc_tokens", (F.col("base") + F.col("window")).alias("sequence_id"), "offset", "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (all its ids, as bytes) and pieces (offset, doc_id, start, length) of each sequence, as a trainer reads it."""
    piece = F.struct("offset", "doc_id", "start", "length", F.hex("ids").alias("hex"))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("rows"))
    ids = F.unhex(F.array_join(F.transform("rows", lambda r: r["hex"]), ""))
    return rows.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("rows", lambda r: r.dropFields("hex")).alias("pieces"))


def digest(packed: DataFrame) -> DataFrame:
    """Each piece with the CRC of its stored ids in place of them."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
