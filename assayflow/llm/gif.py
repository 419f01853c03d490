"""Media columns: GIF images written, read and described.

write_gif() and read_gif() work on one image inside a task; Spark deals out the rows. read_gif() follows
the format in full: LZW code streams with early and late clear codes, global and local palettes,
interlaced rows, transparency, the four disposal rules and delays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.llm.common import stored

#: A payload is a multiple of this many samples: one row of the canvas.
UNIT = 576
#: Rows of a frame at most, and the frame's time in hundredths of a second.
ROWS, DELAY = 64, 4
#: Codes of an 8-bit stream, as the format fixes them.
CLEAR, END, FIRST = 256, 257, 258
LIMIT = 4096
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
_WIDTH: dict[int, np.ndarray] = {}


class Frame(NamedTuple):
    canvas: np.ndarray  # height x width x RGBA, as shown
    box: tuple[int, int, int, int]  # left, top, width, height of what the frame drew
    delay: int  # hundredths of a second


def widths(size: int, n: int) -> np.ndarray:
    """Bits of each of n codes after a clear code, for samples of size bits: the table grows by one a code."""
    if size not in _WIDTH:
        seen = (1 << size) + 1 + np.arange(LIMIT)
        _WIDTH[size] = np.minimum(12, np.maximum(size + 1, np.floor(np.log2(seen)).astype(np.int64) + 1))
    w = _WIDTH[size]
    return w[:n] if n <= LIMIT else np.concatenate([w, np.full(n - LIMIT, 12)])


def lzw_codes(data: bytes) -> list[list[int]]:
    """The codes of 8-bit samples, in runs that each follow a clear code."""
    runs, run, table, free = [], [], {}, FIRST
    get, emit = table.get, run.append
    if not data:
        return [[]]
    prefix = data[0]
    for sample in data[1:]:
        key = prefix << 8 | sample
        code = get(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        if free < LIMIT:
            table[key] = free
            free += 1
        else:
            runs.append(run)
            run, free = [], FIRST
            emit = run.append
            table.clear()
        prefix = sample
    emit(prefix)
    runs.append(run)
    return runs


def pack(runs: list[list[int]]) -> bytes:
    """Codes as a bit stream, low bits first: a clear code before each run, the end code after the last."""
    codes, bits = [np.array([CLEAR])], [np.array([9])]
    for k, run in enumerate(runs):
        last = END if k == len(runs) - 1 else CLEAR
        codes.append(np.append(np.array(run, np.int64), last))
        bits.append(widths(8, len(run) + 1))
    code, bit = np.concatenate(codes), np.concatenate(bits)
    at = np.cumsum(bit) - bit
    value, byte = code << (at & 7), at >> 3
    size = int(at[-1] + bit[-1] + 7 >> 3)
    out = np.zeros(size + 3)
    for k in range(3):
        out[: size + 3] += np.bincount(byte + k, value >> 8 * k & 255, size + 3)
    return out[:size].astype(np.uint8).tobytes()


def lzw_samples(stream: bytes, size: int) -> bytes:
    """Decode a code stream of samples of size bits."""
    bits = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, clear = 8 * len(stream), 0, 1 << size
    single = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, done = [], False
    while not done and at < total:
        table, previous, n = list(single), b"", 0
        while True:  # up to the next clear code, LIMIT codes at a time
            w = widths(size, n + LIMIT)[n:] if n < LIMIT else np.full(LIMIT, 12)
            pos = at + np.cumsum(w) - w
            keep = pos + w <= total
            pos, w = pos[keep], w[keep]
            byte = pos >> 3
            codes = (bits[byte] | bits[byte + 1] << 8 | bits[byte + 2] << 16) >> (pos & 7) & ((1 << w) - 1)
            marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
            stop = int(marks[0]) if len(marks) else len(codes)
            append, add = out.append, table.append
            for code in codes[:stop].tolist():
                size_now = len(table)
                if code < size_now:
                    text = table[code]
                elif previous:
                    text = previous + previous[:1]
                else:
                    raise ValueError("a code stream starts with an unknown code")
                if previous and size_now < LIMIT:
                    add(previous + text[:1])
                append(text)
                previous = text
            if len(marks):
                at = int(pos[stop] + w[stop])
                done = bool(codes[stop] == clear + 1)
                break
            if len(codes) < LIMIT:
                done = True
                break
            n, at = n + LIMIT, int(pos[-1] + w[-1])
    return b"".join(out)


def write_gif(samples: bytes, width: int = UNIT, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """Samples as grey frames of `rows` rows at most, each with its time; the frames together hold all of them."""
    height = min(rows, max(1, len(samples) // width))
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", _GREY]
    for start in range(0, len(samples), width * rows):
        part = samples[start : start + width * rows]
        out.append(b"\x21\xf9\x04\x04" + delay.to_bytes(2, "little") + b"\0\0")  # disposal 1: left in place
        out.append(b"\x2c\0\0\0\0" + width.to_bytes(2, "little") + (len(part) // width).to_bytes(2, "little") + b"\0\x08")
        stream = pack(lzw_codes(part))
        for k in range(0, len(stream), 255):
            block = stream[k : k + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def read_gif(data: bytes) -> list[Frame]:
    """The frames as shown, one after the other, with what each drew and its time."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    number = lambda k: int.from_bytes(data[k : k + 2], "little")
    palette = lambda k, flags: np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, k).reshape(-1, 3)
    width, height, flags, at = number(6), number(8), data[10], 13
    shared = None
    if flags & 128:
        shared = palette(at, flags)
        at += shared.size

    def blocks(k: int) -> tuple[bytes, int]:
        parts = []
        while data[k]:
            parts.append(data[k + 1 : k + 1 + data[k]])
            k += data[k] + 1
        return b"".join(parts), k + 1

    frames, canvas = [], np.zeros((height, width, 4), np.uint8)
    disposal, delay, clear_index = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                clear_index = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h = (number(at + k) for k in (1, 3, 5, 7))
        flags, at = data[at + 9], at + 10
        colours = shared
        if flags & 128:
            colours = palette(at, flags)
            at += colours.size
        if colours is None:
            raise ValueError("a frame without a palette")
        size = data[at]
        stream, at = blocks(at + 1)
        index = np.frombuffer(lzw_samples(stream, size).ljust(w * h, b"\0"), np.uint8, w * h).reshape(h, w)
        if flags & 64:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(index)
            plain[order] = index
            index = plain
        before = canvas.copy() if disposal == 3 else None
        box = canvas[top : top + h, left : left + w]
        index = index[: box.shape[0], : box.shape[1]]
        rgba = np.full((*index.shape, 4), 255, np.uint8)
        rgba[..., :3] = colours[np.minimum(index, len(colours) - 1)]
        if clear_index is None:
            box[:] = rgba
        else:
            drawn = index != clear_index
            box[drawn] = rgba[drawn]
        frames.append(Frame(canvas.copy(), (left, top, w, h), delay))
        if disposal == 2:
            box[:] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, clear_index = 0, 0, None
    return frames


def payload(frames: list[Frame]) -> bytes:
    """The samples that write_gif() stored: the red channel of what each frame drew."""
    return b"".join(f.canvas[y : y + h, x : x + w, 0].tobytes() for f in frames for x, y, w, h in [f.box])


def histogram(frame: Frame) -> list[int]:
    """64 counts of the opaque colours shown, by the two high bits of red, green and blue."""
    red, green, blue, opaque = (frame.canvas[..., k] for k in range(4))
    colour = red >> 6 << 4 | green >> 6 << 2 | blue >> 6
    return np.bincount((colour if opaque.all() else colour[opaque > 0]).ravel(), minlength=64).tolist()


def column_map(df: DataFrame, column: str, schema: str, make: Callable[[bytes | None], dict]) -> DataFrame:
    """df with the fields of schema, made from one binary column inside the tasks, in small batches. Columns of those names are replaced."""
    names = [f.strip().split(" ", 1)[0] for f in schema.split(", ")]  # a type has no blank after its commas
    df = df.drop(*[n for n in names if n != column])
    out_schema = df.select("*", *[F.lit(None).cast(f.strip().split(" ", 1)[1]).alias(f.strip().split(" ", 1)[0]) for f in schema.split(", ")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(out_schema)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = [make(x) for x in batch.column(column).to_pylist()]
                new = [pa.array([m[n] for m in made], fields.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, out_schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text's UTF-8, filled with 255 to a positive multiple of 576, as a GIF in the shared folder.

    A null text is empty; equal texts give equal media; repeated rows stay.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))

    def make(raw: bytes) -> dict:
        return {"n_bytes": len(raw), "media": write_gif(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff"))}

    return stored(column_map(rows, "raw", "n_bytes bigint, media binary", make).drop("raw"), "gif-media")


FRAMES = "array<struct<delay_ms:bigint,left:int,top:int,width:int,height:int,histogram:array<int>>>"


def frame_rows(frames: list[Frame]) -> list[dict]:
    return [{"delay_ms": f.delay * 10, **dict(zip(("left", "top", "width", "height"), f.box, strict=True)), "histogram": histogram(f)} for f in frames]


def frames_of(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds frames, one entry for each timed frame: delay in milliseconds, box and colour histogram. A null image has null frames."""
    return column_map(media, column, f"frames {FRAMES}", lambda data: {"frames": data if data is None else frame_rows(read_gif(data))})


def feature(frames: Column) -> Column:
    """A text of the frames: how many, their time, and the share of each colour that they show, in per mille, `colour:share`."""
    total = F.aggregate(frames, F.array_repeat(F.lit(0).cast("long"), 64), lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    pixels = F.greatest(F.aggregate(total, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    shares = F.transform(total, lambda x, i: F.when(x > 0, F.concat_ws(":", i.cast("string"), F.floor(x * 1000 / pixels).cast("string"))))
    time = F.aggregate(frames, F.lit(0).cast("long"), lambda a, f: a + f["delay_ms"])
    return F.concat(F.lit("frames="), F.size(frames).cast("string"), F.lit(";ms="), time.cast("string"), F.lit(";colours="), F.array_join(shares, ","))


def describe(media: DataFrame) -> DataFrame:
    """Digests of every stored image, from its decoded bytes, with its timed frames and the feature() of their histograms.

    A null image has null in all of them; equal images have equal values; repeated rows stay; an empty table gives an empty one. Columns of
    those names are replaced, all others but media pass through.
    """
    none = dict.fromkeys(("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames"))

    def make(data: bytes | None) -> dict:
        if data is None:
            return none
        frames = read_gif(data)
        own = payload(frames)
        return {
            "payload_bytes": len(own),
            "payload_sha256": hashlib.sha256(own).hexdigest(),
            "tail_crc32": zlib.crc32(own[-32:]),
            "media_bytes": len(data),
            "media_sha256": hashlib.sha256(data).hexdigest(),
            "frames": frame_rows(frames),
        }

    made = column_map(media, "media", f"payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, frames {FRAMES}", make)
    return made.drop("media").withColumn("feature", feature(F.col("frames")))
