"""Request limits in windows that open at a key's first request: over tables by a scan of functions, over streams by event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.sources.shared import shared_dir, stored
from assayflow.streaming.buckets import Buckets, in_buckets

LIMITED = "event_id long, key long, ts timestamp, window_start timestamp, n int, allowed boolean"
#: Neighbouring pieces of a key that are composed into one at a time.
FAN = 32
#: A piece of a key's requests, from its first time to its last (since, upto), as a function of the window that it is entered with: `start` and
#: `n` of the window it leaves open if its first window opens at the time in `at` or before (64-bit integers). A window that outlasts
#: the piece leaves it `size` longer.
PIECE = "key long, piece long, size long, since long, upto long, at binary, start binary, n binary"
ENTRY = "key long, piece long, start long, n long"
NONE = np.iinfo(np.int64).min


def steps(at: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same function with one entry, the last, for each window that is left open: later first windows leave later ones."""
    keep = np.append(start[1:] != start[:-1], True)
    return at[keep], start[keep], n[keep]


def piece_function(ts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """at, start, n of requests at the times ts, in order.

    A window that a piece is entered with was opened at its first time or before, so it ends within a width of that, and
    the first window to open in the piece is that of a request up to there, or of the next one. From there windows
    follow each other; steps of doubled length take as many passes as their number has binary digits.
    """
    every = np.unique(ts)
    at = every[: np.searchsorted(every, ts[0] + width) + 1]
    following = np.searchsorted(every, every + width)
    own = np.where(following == len(every), np.arange(len(every)), following)  # the last window is its own
    while not np.array_equal(own[own], own):
        own = own[own]
    start = every[own[: len(at)]]
    return steps(at, start, len(ts) - np.searchsorted(ts, start))


def arrays(piece: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(piece[c], np.int64) for c in ("at", "start", "n"))


def leave(start: int, n: int, width: int, piece: dict) -> tuple[int, int]:
    """The window that a piece leaves open if it is entered with (start, n); start is NONE where no window is open."""
    if start != NONE and piece["upto"] < start + width:
        return start, n + piece["size"]
    at, starts, counts = arrays(piece)
    i = 0 if start == NONE else int(np.searchsorted(at, start + width))
    return int(starts[i]), int(counts[i])


def composed(pieces: list[dict], width: int) -> dict:
    """Neighbouring pieces as one. It has at most as many entries as the key has times in a window's length, and fewer with every window, as windows that meet go on as one."""
    rest = pieces[-1]
    for p in pieces[-2::-1]:
        at, start, n = arrays(p)
        own_at, own_start, own_n = arrays(rest)
        stays = rest["upto"] < start + width
        i = np.minimum(np.searchsorted(own_at, start + width), len(own_at) - 1)
        start, n = np.where(stays, start, own_start[i]), np.where(stays, n + rest["size"], own_n[i])
        if at[-1] < p["since"] + width:  # a window may outlast this piece, and the first to open be one of the rest
            more = slice(np.searchsorted(own_at, p["upto"], "right"), np.searchsorted(own_at, p["since"] + width) + 1)
            at, start, n = (np.concatenate([x, y[more]]) for x, y in ((at, own_at), (start, own_start), (n, own_n)))
        at, start, n = steps(at, start, n)
        rest = p | {"size": p["size"] + rest["size"], "upto": rest["upto"], "at": at.tobytes(), "start": start.tobytes(), "n": n.tobytes()}
    return rest


def _compose(pieces: DataFrame, width: int) -> DataFrame:
    """FAN neighbouring pieces of a key as one, numbered anew."""
    fan = FAN

    def up(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        return pa.Table.from_pylist([composed(rows, width) | {"piece": rows[0]["piece"] // fan}], table.schema)

    return pieces.groupBy("key", F.expr(f"piece div {fan}")).applyInArrow(up, PIECE)


def _enter(pieces: DataFrame, entries: DataFrame, width: int) -> DataFrame:
    """With which window each piece is entered, from that of the FAN pieces that it is one of."""
    known = entries.select(F.col("key").alias("__key"), F.col("piece").alias("__block"), F.col("start").alias("__start"), F.col("n").alias("__n"))
    rows = pieces.withColumn("__block", F.expr(f"piece div {FAN}"))
    rows = rows.join(known.withColumnRenamed("__block", "__of"), (F.col("key") == F.col("__key")) & (F.col("__block") == F.col("__of"))).drop("__key", "__of")

    def down(table: pa.Table) -> pa.Table:
        out, rows = [], sorted(table.to_pylist(), key=lambda r: r["piece"])
        start, n = rows[0]["__start"], rows[0]["__n"]
        for r in rows:
            out.append({"key": r["key"], "piece": r["piece"], "start": start, "n": n})
            start, n = leave(start, n, width, r)
        return pa.Table.from_pylist(out, pa.schema([(c, pa.int64()) for c in ("key", "piece", "start", "n")]))

    return rows.groupBy("key", "__block").applyInArrow(down, ENTRY)


def entering_windows(pieces: DataFrame, width: int, ranges: int) -> DataFrame:
    """key, piece, start, n: with which window each of the pieces, numbered below ranges, is entered. pieces is read several times and has to be a stored table.

    A scan over functions: pieces of a key, which are numbered in order, are composed FAN at a time until no key has more than FAN; the first
    is entered without a window, each other one with what those before it leave, and so back down to the pieces. A task holds FAN pieces.
    """
    levels = [pieces]
    while ranges > FAN:
        levels.append(stored(_compose(levels[-1], width), "limit-pieces"))
        ranges = -(-ranges // FAN)
    entries = levels[-1].select("key", F.lit(0).cast("long").alias("piece"), F.lit(NONE).alias("start"), F.lit(0).cast("long").alias("n")).distinct()
    while levels:
        entries = _enter(levels.pop(), entries, width)
    return entries


def _runs(batch: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray]:
    """The keys of a batch in order, where each begins, and the times in microseconds."""
    keys = batch.column("key").to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[begin].tolist(), np.append(begin, len(keys)), _micros(batch).to_numpy(zero_copy_only=False)


def _micros(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("ts").cast(pa.timestamp("us", "UTC")).cast(pa.int64())


def rate_limit(requests: DataFrame, limit: int = 10, window_s: int = 60) -> DataFrame:
    """Each of requests(event_id, key, ts) with its window, its number in it and whether it is allowed.

    A window opens at a key's first request after the last one closed and lasts window_s; refused requests
    count. The requests are cut into ranges of key, time and id, so a key with a third of all rows is many tasks.
    A key that goes on from one range to the next is a piece in each: first every piece says for each window that it
    may be entered with which one it leaves open, then these functions are composed (entering_windows), and in the end each
    range is numbered by itself from the window that it is entered with. Rows without key or time are left out.
    """
    spark, width = requests.sparkSession, window_s * 1_000_000
    rows = requests.select("event_id", "key", F.col("ts").cast("timestamp").alias("ts")).where(F.col("key").isNotNull() & F.col("ts").isNotNull())
    order = ["key", "ts", "event_id"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # A checkpoint keeps partitions and their order, so both passes see the same ranges.
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).checkpoint()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The functions of a range's first and last key: only those can be in another range too."""
        piece, first, key, times, out = TaskContext.get().partitionId(), None, None, [], []

        def row(k: int, parts: list) -> dict:
            ts = np.concatenate(parts)
            at, start, n = piece_function(ts, width)
            return {"key": k, "piece": piece, "size": len(ts), "since": int(ts[0]), "upto": int(ts[-1]), "at": at.tobytes(), "start": start.tobytes(), "n": n.astype(np.int64).tobytes()}

        for batch in batches:
            keys, edges, ts = _runs(batch)
            for k, a, b in zip(keys, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if k != key and key is not None:
                    if key == first:
                        out.append(row(key, times))
                    times = []
                first = k if first is None else first
                key = k
                times.append(ts[a:b])
        if key is not None:
            out.append(row(key, times))
        yield pa.RecordBatch.from_pylist(out, pa.schema([(c, pa.binary() if c in ("at", "start", "n") else pa.int64()) for c in ("key", "piece", "size", "since", "upto", "at", "start", "n")]))

    pieces = stored(rows.select("key", "ts").mapInArrow(ends, PIECE), "limit-pieces")
    entered = entering_windows(pieces, width, ranges).where(F.col("start") != NONE).collect()  # one row a range at most: its first key's
    entries = {(r["piece"], r["key"]): (r["start"], r["n"]) for r in entered}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, n, piece = None, 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            starts, counts = [], []
            ts = _micros(batch)
            for k, t in zip(batch.column("key").to_pylist(), ts.to_pylist(), strict=True):
                if k != key:
                    start, n = entries.get((piece, k), (t - width, 0))
                    key = k
                if t >= start + width:
                    start, n = t, 0
                n += 1
                starts.append(start)
                counts.append(n)
            stamp = pa.timestamp("us", "UTC")
            yield pa.RecordBatch.from_arrays(
                [batch.column("event_id"), batch.column("key"), ts.cast(stamp), pa.array(starts, pa.int64()).cast(stamp), pa.array(counts, pa.int32()), pa.array([c <= limit for c in counts], pa.bool_())],
                names=["event_id", "key", "ts", "window_start", "n", "allowed"],
            )

    return rows.mapInArrow(walk, LIMITED)


class Limiter(Buckets):
    """Holds the requests of a bucket's keys until the watermark has passed them, and numbers them in the order of their times.

    A bucket is [waiting, open]: requests (key, time, known, id) that others may still come before, and of each key the last window's
    start and count. It is looked at again at the first waiting request or the end of the first open window, which is then forgotten. Times are in microseconds.
    """

    columns = ["event_id", "key", "ts", "window_start", "n", "allowed"]
    types = {"event_id": "Int64", "key": "int64", "ts": "int64", "window_start": "int64", "n": "int32", "allowed": "bool"}

    def __init__(self, limit: int, window_s: int):
        self.limit, self.width = limit, window_s * 1_000_000

    def empty(self) -> list:
        return [[], {}]

    def take(self, held: list, rows: Iterator[pd.DataFrame], mark: int) -> tuple[list[tuple], int | None]:
        for frame in rows:
            held[0].extend(zip(*(frame[c].tolist() for c in ("key", "us", "known", "event_id")), strict=True))
        return self.expire(held, mark)

    def expire(self, held: list, mark: int) -> tuple[list[tuple], int | None]:
        """Number what no request can come before any more: all up to the watermark, as later ones of such times are dropped."""
        waiting, opened = held
        mark *= 1000
        held[0] = [r for r in waiting if r[1] > mark]
        out = []
        for key, us, known, i in sorted(r for r in waiting if r[1] <= mark):
            start, n = opened.get(key, (None, 0))
            if start is None or us >= start + self.width:
                start, n = us, 0
            n += 1
            opened[key] = start, n
            out.append((i if known else None, key, us, start, n, n <= self.limit))
        held[1] = {k: w for k, w in opened.items() if mark < w[0] + self.width}
        first = min([r[1] for r in held[0]] + [start + self.width for start, _ in held[1].values()], default=None)
        return out, None if first is None else -(-first // 1000)


def rate_limit_stream(requests: DataFrame, limit: int = 10, window_s: int = 60, delay: str = "0 seconds") -> DataFrame:
    """rate_limit() over a stream, in the order of the requests' times however they arrive.

    A request waits in state until the watermark, `delay` behind the newest request of all, has passed it; one that
    comes after requests of its time have been numbered is dropped. So the rows are those of rate_limit() over all that weren't dropped. A key's state
    ends with its last window. Rows without key are left out, but their times move the watermark: one such row
    in the future lets all waiting ones go.
    """
    # One condition on both columns isn't pushed below the watermark, which rows without key move too.
    whole = F.forall(F.array(F.col("key").isNotNull(), F.col("ts").isNotNull()), lambda x: x)
    rows = requests.select("event_id", "key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay).where(whole)
    # No nulls among the integers, which pandas would make doubles of.
    rows = rows.select(F.coalesce("event_id", F.lit(0).cast("long")).alias("event_id"), F.col("event_id").isNotNull().alias("known"), F.coalesce("key", F.lit(0).cast("long")).alias("key"), "ts", F.unix_micros("ts").alias("us"))
    found = in_buckets(rows, F.col("key"), Limiter(limit, window_s), "event_id long, key long, ts long, window_start long, n int, allowed boolean")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("ts", "window_start")})
