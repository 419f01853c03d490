"""Byte-level BPE: ranked merges folded over the bytes of distinct pieces, and decoding by concatenation."""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.llm.common import kept
from assayflow.llm.pieces import BYTE_LEVEL, Memory, splitter

#: Pieces of this many bytes or more are merged through a queue of pairs, in n log n steps.
LONG = 48
#: Texts encoded at a time, and encoded pieces that a worker remembers in a generation (about 200 bytes each).
TEXTS, PIECES = 64, 250_000
_ranks: dict[str, dict[bytes, int]] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank map of a file of base64 pieces and ranks, read once a process. Its size is the vocabulary's."""
    if path not in _ranks:
        with open(path, "rb") as f:
            _ranks[path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _ranks[path]


def fold(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the neighbouring pair of least rank is merged, the leftmost first, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) >= LONG:
        return fold_long(piece, ranks)
    never, get = len(ranks) + 1, ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], never) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least == never:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], never)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], never)
    return [ranks[p] for p in parts]


def fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As fold(), with a queue of (rank, place) over a linked list."""
    n, get = len(piece), ranks.get
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is piece[i:end[i]]; back[i] is where the part before starts
    queue = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            rank = get(piece[i : end[j]])
            if rank is not None:
                heapq.heappush(queue, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while queue:
        _, i, stop = heapq.heappop(queue)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            back[stop] = i
        offer(i)
        if back[i] >= 0:
            offer(back[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def encode_texts(texts: list[str], split: Callable, memory: Memory) -> list[bytes]:
    """Ids of each text as 32-bit integers; only pieces that the memory lacks are encoded."""
    pieces = [split(t) for t in texts]
    memory.learn(chain.from_iterable(pieces))
    get = memory.__getitem__
    return [b"".join(map(get, p)) for p in pieces]


def list_array(flat: np.ndarray, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))


def encode(docs: DataFrame, ranks_path: str, pattern: str = BYTE_LEVEL, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ids, an array of token ids, for every text; a null text is empty. No special tokens.

    Every batch is split into pieces; the distinct ones that the worker has not met are folded by rank.
    A column of that name is replaced; all others pass through.
    """
    docs = docs.drop(ids)
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split = load_ranks(ranks_path), splitter(pattern)
        memory = kept(("ranks", ranks_path), lambda: Memory(lambda new: [np.array(fold(p.encode(), ranks), "<i4").tobytes() for p in new], PIECES))
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                own = encode_texts([t or "" for t in batch.column(text).to_pylist()], split, memory)
                flat = np.frombuffer(b"".join(own), "<i4")
                yield pa.RecordBatch.from_arrays([*batch.columns, list_array(flat, [len(b) // 4 for b in own])], names=[*batch.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds decoded, the binary pieces of the ids put together; a null array gives null, an empty one no bytes, an id without a piece is an error.

    Higher-order functions alone: the pieces are a literal array, as text of one character a byte, which is joined and
    turned to bytes. A column of that name is replaced; repeated rows stay; an empty table gives an empty one.
    """
    pieces: list = [None] * (max(load_ranks(ranks_path).values()) + 1)
    for piece, rank in load_ranks(ranks_path).items():
        pieces[rank] = piece.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    text = F.array_join(F.transform(F.col(ids), lambda i: table[i]), "")
    return tokens.drop(decoded).withColumn(decoded, F.encode(text, "ISO-8859-1"))


def encode_pieces_native(pieces: DataFrame, ranks_path: str, piece: str = "piece", ids: str = "ids") -> DataFrame:
    """As encode() for a table of distinct pieces, with higher-order functions alone.

    The rank map is a literal: an array of small maps by hash, since Spark searches a map from its start.
    It gives the same ids, at some hundred microseconds a piece; encode() is the fast way.
    """
    parts = 1 << 15
    buckets: list[dict] = [{} for _ in range(parts)]
    for p, r in load_ranks(ranks_path).items():
        key = p.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % parts][key] = r
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
    rank = lambda w: F.try_element_at(F.get(table, F.pmod(F.crc32(w.cast("binary")), F.lit(parts)).cast("int")), w)
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def step(acc: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), lambda x, i: rank(F.concat(x, F.get(acc, i + 1))))
        merge = lambda p: F.concat(F.slice(acc, F.lit(1), p - 1), F.array(F.concat(F.element_at(acc, p), F.element_at(acc, p + 1))), F.slice(acc, p + 2, F.size(acc)))
        return let(pairs, lambda r: let(F.array_min(r), lambda m: F.when(m.isNull(), acc).otherwise(let(F.array_position(r, m).cast("int"), merge))))

    raw = F.decode(F.encode(F.col(piece), "UTF-8"), "ISO-8859-1")  # one character a byte
    single = F.filter(F.split(raw, ""), lambda x: x != "")
    merged = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(raw) - 1, F.lit(1))), single, step)
    return pieces.withColumn(ids, F.transform(merged, rank))
