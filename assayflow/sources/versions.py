"""Tables that change as a whole: folders of rows that are written once, and manifests that say which of them count.

A change writes new folders first and then renames one manifest to its place. A reader takes the manifest that is there when it
begins and reads the folders it names, which nothing overwrites: it sees the rows before a change or after it. Folders that no
manifest names any more stay until vacuum() is called.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Hash partitions of an upserted table, and how many of the last commits a manifest remembers.
BUCKETS, COMMITS = 64, 1000


def _put(path: str, name: str, said: dict) -> None:
    """Write a manifest under another name and rename it."""
    fs, root = pafs.FileSystem.from_uri(f"{path}/manifests")
    fs.create_dir(root, recursive=True)
    draft = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(json.dumps(said).encode())
    fs.move(draft, f"{root}/{name}")


def _names(path: str) -> list[str]:
    fs, root = pafs.FileSystem.from_uri(f"{path}/manifests")
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))


def _get(path: str, name: str) -> dict:
    fs, root = pafs.FileSystem.from_uri(f"{path}/manifests/{name}")
    with fs.open_input_file(root) as f:
        return json.loads(f.read())


def _read(spark: SparkSession, path: str, folders: list[str], schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


# Batches


def commit_batch(rows: DataFrame, path: str, batch: str | int) -> None:
    """Add the rows of a batch, or replace those of the same batch that is tried again, at once."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    _put(path, f"batch-{batch}.json", {"folders": [folder], "schema": rows.schema.json()})


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches, each whole as of its last commit. There has to be one at least, as it gives the columns."""
    said = [_get(path, n) for n in _names(path)]
    if not said:
        raise FileNotFoundError(f"no batch was committed to {path}")
    return _read(spark, path, [f for m in said for f in m["folders"]], StructType.fromJson(json.loads(said[-1]["schema"])))


# Versions


def current_version(path: str) -> dict | None:
    """The manifest of the newest version: version, schema, buckets (number -> folder), n_buckets, key and the last commits."""
    names = _names(path)
    return _get(path, names[-1]) if names else None


def read_version(spark: SparkSession, path: str, manifest: dict | None = None) -> DataFrame:
    """The rows of the newest version, or of the manifest of another one."""
    m = manifest or current_version(path)
    if m is None:
        raise FileNotFoundError(f"no version was committed to {path}")
    return _read(spark, path, sorted(m["buckets"].values()), StructType.fromJson(json.loads(m["schema"])))


def upsert_version(path: str, new: DataFrame, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], commit: str | int | None = None, n_buckets: int = BUCKETS, schema: StructType | str | None = None) -> int:
    """Merge new rows into the table at path as its next version, and return that one's number.

    Rows are dealt to buckets by a hash of key, nulls alike; merge(old rows, new rows) must decide among rows of equal keys and leave keys as
    they are. Only the buckets that new rows fall into are read and written again, the others go on as they are. A table
    that isn't there yet begins empty, with the columns of schema or else of the new rows. A commit that the table remembers
    is not made again, so a retry changes nothing. One writer at a time: a version that another one has made meanwhile is an error.
    """
    spark, now = new.sparkSession, current_version(path)
    if now and commit is not None and str(commit) in now["commits"]:
        return now["version"]
    n = now["n_buckets"] if now else n_buckets
    if now and now["key"] != key:
        raise ValueError(f"the table's key is {now['key']}")
    bucket = F.pmod(F.xxhash64(*key), F.lit(n))
    touched = sorted(r["b"] for r in new.select(bucket.alias("b")).distinct().collect())  # n at most
    old = now["buckets"] if now else {}
    have = StructType.fromJson(json.loads(now["schema"])) if now else schema or new.schema
    rows = merge(_read(spark, path, [old[str(b)] for b in touched if str(b) in old], have), new)
    folder = f"data/{uuid.uuid4().hex}"
    # Rebalanced, so that files of a bucket are few, and a large bucket is several tasks.
    rows.withColumn("__bucket", bucket).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{path}/{folder}")
    fs, root = pafs.FileSystem.from_uri(f"{path}/{folder}")
    written = {f.base_name.removeprefix("__bucket="): f"{folder}/{f.base_name}" for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("__bucket=")}
    if not {int(b) for b in written} <= set(touched):
        raise ValueError("merge() changed keys")
    buckets = {b: f for b, f in old.items() if int(b) not in touched} | written
    version = now["version"] + 1 if now else 1
    commits = [*(now["commits"] if now else []), *([] if commit is None else [str(commit)])][-COMMITS:]
    name = f"v{version:020d}.json"
    if name in _names(path):
        raise RuntimeError(f"version {version} of {path} was made by another writer")
    _put(path, name, {"version": version, "schema": rows.schema.json(), "key": key, "n_buckets": n, "buckets": buckets, "commits": commits})
    return version


def vacuum(path: str, keep: int = 2) -> int:
    """Remove versions but the last `keep`, and folders that no manifest names; no reader of those and no writer may be at work. Returns how many folders went."""
    fs, root = pafs.FileSystem.from_uri(path)
    versions = [n for n in _names(path) if n.startswith("v")]
    for n in versions[: max(0, len(versions) - keep)]:
        fs.delete_file(f"{root}/manifests/{n}")
    named = set()
    for n in _names(path):
        m = _get(path, n)
        named |= {f.split("/")[1] for f in m.get("folders", []) + list(m.get("buckets", {}).values())}
    gone = [f for f in fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True)) if f.base_name not in named]
    for f in gone:
        fs.delete_dir(f.path)
    return len(gone)
