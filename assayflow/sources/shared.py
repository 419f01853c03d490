"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new folder if all of Spark runs in this one process, as in tests; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='assayflow-')}")
        base = _own[0]
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Removes what was written under new shared paths within it, but those that are put into the list it gives, and what was to stay of inner ones.

    For a step whose result is written by its end: nothing reads its intermediate tables any more. An error leaves them.
    """
    first, stays = len(_made), []
    yield stays
    for path in [p for p in _made[first:] if p not in stays]:
        fs, root = pafs.FileSystem.from_uri(path)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)
    _made[first:] = stays


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """df with a broadcast hint if it is counted to hold at most max_rows; otherwise df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def numbered(df: DataFrame, *order: Column | str, no: str = "no") -> DataFrame:
    """Adds no: 0, 1, 2... of all rows in that order, without a task that sees them all.

    Rows are dealt by ranges of the order, which can be as dense or sparse as it likes, and sorted within; a row's number is its place
    in its range and the rows of the ranges before, a prefix sum over one row each. The placed rows are stored, so that ties keep the
    places they were counted with.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy(F.shiftright("__place", 33).alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.col("__place").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("__range", F.shiftright("__place", 33)).join(small(bases), "__range").withColumn(no, F.col("__base") + place).drop("__range", "__base", "__place")


def write_blocks(df: DataFrame, block: str, n: int, name: str) -> str:
    """Write df in n blocks, by its column of the block's number, for tasks to read one at a time. The path in the shared folder."""
    path = shared_path(df.sparkSession, name)
    df.repartition(n, block).write.partitionBy(block).parquet(path)
    return path


def read_block(path: str, block: str, no: int) -> pa.Table | None:
    """In a task: one of the blocks that write_blocks() wrote; None if it has no rows."""
    fs, root = pafs.FileSystem.from_uri(f"{path}/{block}={no}")
    if fs.get_file_info(root).type == pafs.FileType.NotFound:
        return None
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")]
    tables = []
    for f in sorted(files):
        with fs.open_input_file(f) as source:
            tables.append(pq.ParquetFile(source).read())
    return pa.concat_tables(tables) if tables else None
