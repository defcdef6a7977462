"""Ingestion of reviews as they arrive: one state for each text and rating, with its count and the row that stands for it.

The state is what the batch operator would have made of all rows so far, in whatever order they came, so a stream ends with the batch's signals. It survives a restart in the query's
checkpoint, and each micro-batch is written under its number, so a batch that is run again replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gapengine.operators import ingest

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BODY = "iso string, source_id string, version_id string, text string, package_name string, rating double, timestamp timestamp"
UPDATE = f"key string, n long, {BODY}, is_closed boolean"
FIELDS = [x.split()[0] for x in BODY.split(", ")]


def plain(value: Any) -> Any:
    """A value of a pandas row as Spark's state takes it: missing ones are None, times are datetimes."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


class Signals(StatefulProcessor):
    """Counts the rows of a key and keeps the one that is last by (time, source_id, version, text). Each batch that brings rows of a key gives its signal as it is now.

    quiet_ms, if given: a key that had no rows for so long is given once more, as closed, and forgotten; should it come again it counts anew.
    """

    def __init__(self, quiet_ms: int | None = None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("signal", f"n long, {BODY}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, best = 0, None
        if self.state.exists():
            held = self.state.get()
            n, best = held[0], tuple(held[1:])
        for frame in rows:
            n += len(frame)
            for row in frame[FIELDS].itertuples(index=False, name=None):
                row = tuple(plain(x) for x in row)
                if best is None or row[:4] > tuple(best[:4]):
                    best = row
        self.state.update((n, *best))
        if self.quiet_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield self._row(key, n, best, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            held = self.state.get()
            self.state.clear()
            yield self._row(key, held[0], tuple(held[1:]), True)

    def _row(self, key: Any, n: int, best: tuple, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "n": [n], **{f: [v] for f, v in zip(FIELDS, best, strict=True)}, "is_closed": [closed]})

    def close(self) -> None:
        pass


def updates(stream: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """A row for each key that a batch touches: key, n and the standing row. stream: a stream of raw rows, as operators.ingest.triaged() takes them. Rows that aren't ok are left out.

    Without quiet_ms it is an aggregation, whose state stays in the JVM; only keys that may be closed need a processor with timers.
    """
    ok = ingest.triaged(stream).where("status = 'ok'")
    keyed = ok.select(ingest.dedup_key(F.col("text"), F.col("rating")).alias("key"), ingest.iso(F.col("timestamp")).alias("iso"), "source_id", "version_id", "text", "package_name", F.col("rating").cast("double").alias("rating"), "timestamp")
    if quiet_ms is None:
        told = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct(*FIELDS)).alias("x"))
        return told.select("key", "n", "x.*", F.lit(False).alias("is_closed"))
    return keyed.groupBy("key").transformWithStateInPandas(Signals(quiet_ms), UPDATE, "Update", "ProcessingTime")


def write(stream: DataFrame, folder: str, checkpoint: str, quiet_ms: int | None = None, **trigger: Any):
    """Starts the query: each micro-batch of updates goes to a folder of its number. trigger: as writeStream.trigger() takes it."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return updates(stream, quiet_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(save).start()


def current(written: DataFrame, source: str = "reviews") -> DataFrame:
    """The signals as they are now, of all updates that were written: operators.ingest.deduplicated() of all rows so far. Of a key that was closed and came again, its closed parts are added up."""
    body = F.struct("package_name", "text", "rating", "timestamp", "source_id", "version_id")
    order = F.struct("iso", "source_id", "version_id", "text")
    part = F.sum(F.col("is_closed").cast("int")).over(W.partitionBy("key").orderBy("batch", F.col("is_closed").cast("int")).rowsBetween(W.unboundedPreceding, -1))
    parts = written.withColumn("part", F.coalesce(part, F.lit(0))).groupBy("key", "part").agg(F.max("n").alias("n"), F.max_by(F.struct(body.alias("x"), order.alias("o")), "n").alias("b"))
    groups = parts.groupBy("key").agg(F.sum("n").cast("int").alias("n"), F.max_by("b.x", "b.o").alias("x"))
    return ingest.signals(groups, source)
