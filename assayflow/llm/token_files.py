"""Token ids as flat unsigned integer files with 64-bit document offsets, to be memory-mapped.

A shard is two files: `<name>.bin`, all its ids as little-endian unsigned integers (16 bits where the
vocabulary allows), and `<name>.idx`, one (doc_id, offset of its first id, is it null) of 64 bits each per
document and a last one that holds the end. The manifest table has one row a shard, with the number of
ids before it (`base`): a prefix sum over shards, so no task counts another's tokens.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayflow.llm.bpe import TEXTS, encode_texts
from assayflow.llm.common import kept, stored
from assayflow.llm.pieces import BYTE_LEVEL, Memory, splitter
from assayflow.sources.shared import shared_path

MANIFEST = "shard long, part long, name string, n_docs long, n_tokens long, width int"
#: Encoded pieces that a worker remembers in a generation, about 200 bytes each: the library needs longer for a piece than a fold.
PIECES = 800_000
#: A shard ends with the document that brings it to so many ids; bytes are written when so many wait.
SHARD_IDS, WAITING = 1 << 26, 1 << 20
INDEX = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("null", "<i8")])
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def piece_pattern(path: str) -> str | None:
    """The pattern whose matches the tokenizer of a file encodes one by one; None if the file says anything else than that plain kind."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    before = said.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    whole = said.get("normalizer") or said.get("truncation") or said.get("padding") or said["model"].get("dropout")
    return BYTE_LEVEL if plain and not whole else None


def encoder(path: str) -> Callable[[pa.Array], Iterator[tuple[int, list[np.ndarray]]]]:
    """A function that gives the ids of an array of texts, some texts at a time with the place of the first; null is empty.

    A plain byte-level tokenizer encodes each match of its pattern by itself, so the library encodes each distinct
    piece once and a text's ids are those of its pieces. Texts that hold the string of an added token go to the
    library whole, and so does every text if the tokenizer's file names a normalizer or another pre-tokenizer.
    """
    tok = tokenizer(path)
    kind = np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")
    pattern = piece_pattern(path)
    split = splitter(pattern) if pattern else None
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    library = lambda new: [np.array(e.ids, kind).tobytes() for e in tok.encode_batch_fast(new, add_special_tokens=False)]
    memory = kept(("tokenizer", path), lambda: Memory(library, PIECES))

    def encode(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        for at in range(0, len(texts), TEXTS):
            some = [t or "" for t in texts.slice(at, TEXTS).to_pylist()]
            special = [k for k, t in enumerate(some) if not split or any(a in t for a in added)]
            own = encode_texts(["" if k in special else t for k, t in enumerate(some)], split, memory) if split else [b""] * len(some)
            for k in special:  # the library alone says what an added token's string is
                own[k] = library([some[k]])[0]
            yield at, [np.frombuffer(b, kind) for b in own]

    return encode


class ShardFile:
    """One shard as it is written: its ids go out as they come, its index at the end."""

    def __init__(self, fs: pafs.FileSystem, root: str, task: int, part: int, kind: np.dtype, end_id: int):
        self.name = f"part-{task:06d}-{part:04d}-{uuid.uuid4().hex}"
        self.fs, self.root, self.task, self.part, self.kind = fs, root, task, part, kind
        self.end, self.out = np.array([end_id], kind).tobytes(), fs.open_output_stream(f"{root}/{self.name}.bin")
        self.n, self.index, self.waiting, self.bytes = 0, [], [], 0

    def flush(self) -> None:
        self.out.write(b"".join(self.waiting))
        self.waiting, self.bytes = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, self.n, doc_id is None))
        self.waiting += (ids.astype(self.kind, copy=False).tobytes(), self.end)
        self.n += len(ids) + 1
        self.bytes += ids.nbytes
        if self.bytes >= WAITING:
            self.flush()

    def close(self) -> pa.RecordBatch:
        """Its row of the manifest."""
        self.flush()
        self.out.close()
        with self.fs.open_output_stream(f"{self.root}/{self.name}.idx") as out:
            out.write(np.array([*self.index, (0, self.n, 0)], INDEX).tobytes())
        row = (self.task, self.part, self.name, len(self.index), self.n, self.kind.itemsize)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["shard", "part", "name", "n_docs", "n_tokens", "width"])


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text", partitions: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every text, append end_id, write the shards in ascending order of id and return the manifest.

    Documents are dealt by ranges of id (and a hash of the text, so that a repeated id can be split) and
    sorted within. Ids are nulls last; equal ids come in order of that hash. A null text is empty. A task
    begins a new shard when one has shard_ids, so a file's size doesn't grow with the table or with a task's share. A task
    that runs twice writes other names; the manifest names the files of the one that counted.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path)
        kind = np.dtype("<u2" if max(tokenizer(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        task, part = TaskContext.get().partitionId(), 0
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, own in ids_of(batch.column("text")):
                for k, ids in enumerate(own):
                    if part == 0 or file.n >= shard_ids:
                        if part:
                            yield file.close()
                        file, part = ShardFile(fs, root, task, part, kind, end_id), part + 1
                    file.add(doc_ids[at + k], ids)
        if part:
            yield file.close()

    shards = stored(rows.select("doc_id", "text").mapInArrow(encode, MANIFEST), "token-shards")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    manifest = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, base long").parquet(f"{folder}/manifest")


def mapped(fs: pafs.FileSystem, path: str, dtype: np.dtype) -> np.ndarray:
    """A file as an array: memory-mapped where it is local, else read."""
    if fs.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(f.size()), dtype)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    ids_crc32 is taken over the ids as little-endian 32-bit integers.
    """
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for s in batch.to_pylist():
                ids = mapped(fs, f"{root}/{s['name']}.bin", np.dtype(f"<u{s['width']}"))
                index = mapped(fs, f"{root}/{s['name']}.idx", INDEX)
                for at in range(0, len(index) - 1, 4096):
                    own = np.array(index[at : at + 4097])
                    crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(own["start"][:-1].tolist(), own["start"][1:].tolist(), strict=True)]
                    docs = own[:-1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs["doc_id"], mask=docs["null"] == 1), pa.array(docs["start"] + s["base"]), pa.array(np.diff(own["start"])), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents as token files in the shared folder and return what is read back."""
    folder = shared_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer_path), folder)
