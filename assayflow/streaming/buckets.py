"""State of many keys in one group of a stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Groups that keys are dealt to by hash. A group's rows of a micro-batch and its state are in memory at a time, so it sets no limit on keys, only on memory.
BUCKETS = 1024
HELD = T.StructType([T.StructField("held", T.BinaryType()), T.StructField("due", T.LongType())])


class Buckets(StatefulProcessor):
    """Keeps one object for a bucket, with the states of all its keys, and one timer, in milliseconds, for the first of them that is due.

    A micro-batch costs some calls for each bucket that it has rows or a timer in, however many keys there are.
    Subclasses say what an empty bucket is (empty), take rows (take) and what is due at a watermark (expire); both give output and the next due time, if any.
    """

    columns: list[str]
    types: dict[str, str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("held", HELD)

    def load(self) -> tuple:
        """The bucket's object and when its timer is set to."""
        if not self.state.exists():
            return self.empty(), None
        held, due = self.state.get()
        return pickle.loads(held), due

    def save(self, held, was: int | None, due: int | None) -> None:
        """Keep the object and move the timer; due None: there is nothing to keep."""
        if was is not None and was != due:
            self.handle.deleteTimer(was)
        if due is None:
            self.state.clear()
            return
        self.state.update((pickle.dumps(held), due))
        if was != due:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, was = self.load()
        out, due = self.take(held, rows, timerValues.getCurrentWatermarkInMs())
        self.save(held, was, due)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self.load()
        out, due = self.expire(held, timerValues.getCurrentWatermarkInMs())
        self.save(held, None, due)  # its timer is over
        yield self.frame(out)

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.columns).astype(self.types)

    def close(self) -> None:
        pass


def in_buckets(rows: DataFrame, key: Column, processor: StatefulProcessor, output: str) -> DataFrame:
    """rows, which have a watermark, through the processor by buckets of the key."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime")
