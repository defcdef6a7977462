"""Streams end with the batch's results, in any order of arrival and across restarts."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from gapengine.operators import ingest
from gapengine.streaming import ingest as stream_ingest
from gapengine.streaming import signals as stream_signals

RAW = "package string, text string, rating string, time string, source_id string, version string"


def raw(seed, n=60):
    r = random.Random(seed)
    texts = ["Great app", "great  APP", "Cannot log in", "It is slow", "  ", "Straße", "STRASSE"]
    return [(r.choice(["own", "Own "]), r.choice(texts), r.choice(["1", "5", "9", None]), r.choice(["2024-01-01", "2024-03-05", None, "soon"]), str(k % 40), r.choice(["", "2"])) for k in range(n)]


def shown(df):
    return sorted(map(repr, df.select("id", "source_id", "text", "timestamp", "rating", "package_name", "metadata.duplicate_count", "metadata.version_id").collect()))


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1]])
def test_micro_batches_in_any_order_and_a_restart_give_the_batch(spark, tmp_path, order):
    parts = [raw(1), raw(2), raw(3)]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in order[:2]:
        spark.createDataFrame(parts[k], RAW).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream_ingest.write(stream, out, state)
    query.awaitTermination()
    half = shown(stream_ingest.current(spark.read.parquet(out)))
    rows = spark.createDataFrame([x for k in order[:2] for x in parts[k]], RAW)
    assert half == shown(ingest.deduplicated(ingest.triaged(rows).where("status = 'ok'")))
    spark.createDataFrame(parts[order[2]], RAW).coalesce(1).write.mode("append").parquet(source)
    stream_ingest.write(stream, out, state).awaitTermination()  # goes on from the checkpoint
    batches = spark.read.parquet(out).select("batch").distinct().count()
    rows = spark.createDataFrame([x for p in parts for x in p], RAW)
    assert batches == 3 and shown(stream_ingest.current(spark.read.parquet(out))) == shown(ingest.deduplicated(ingest.triaged(rows).where("status = 'ok'")))


def test_closed_keys_are_added_up(spark):
    row = lambda batch, n, iso, closed: ("k", n, iso, "1", "", "a text", "own", 1.0, None, closed, batch)
    written = spark.createDataFrame([row(0, 2, "2024-01-01", False), row(1, 3, "2024-02-01", False), row(2, 3, "2024-02-01", True), row(5, 1, "2024-01-15", False)], f"{stream_ingest.UPDATE}, batch int")
    assert [(r.metadata.duplicate_count, r.text) for r in stream_ingest.current(written).collect()] == [(4, "a text")]


def test_counts_of_windows_and_repeats(spark, tmp_path):
    rows = [("own", f"2024-01-01 0{h}:10:00", "same text", 1.0 + h % 2) for h in (1, 1, 2, 3, 3)]
    df = spark.createDataFrame(rows, "package string, t string, text string, rating double").withColumn("timestamp", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, made in (("counted", stream_signals.counted(stream, "package")), ("once", stream_signals.deduplicated(stream, late="1 day"))):
        made.writeStream.format("memory").queryName(name).outputMode("append" if name == "once" else "update").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.window_start.hour, r.n, r.mean_rating) for r in spark.table("counted").collect()) == [(1, 2, 2.0), (2, 1, 1.0), (3, 2, 2.0)]
    assert sorted(r.rating for r in spark.table("once").collect()) == [1.0, 2.0]


def test_a_stream_without_timers_runs_no_python_for_each_key(spark):
    """Its state is an aggregation's (before: a Python processor called for each key of each batch); closing keys still takes the processor."""
    stream = spark.readStream.format("rate").load().select(*[F.lit("1").alias(x.split()[0]) for x in RAW.split(", ")])
    plans = [stream_ingest.updates(stream, quiet)._jdf.queryExecution().analyzed().toString() for quiet in (None, 1000)]
    assert ["TransformWithState" in x for x in plans] == [False, True]
    assert stream_ingest.updates(stream).dtypes == stream_ingest.updates(stream, 1000).dtypes
