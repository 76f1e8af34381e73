"""Streaming twins of the audit aggregates, and the accumulation of run states."""

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from fathom.operators import audit
from fathom.session import table_dir

SILENCE_MS = 3_600_000


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table, a file or a folder of files, as a stream; ts becomes an event time with ten minutes of patience."""
    schema = spark.read.parquet(path).schema
    as_pattern = f"{path[:-1]}[{path[-1]}]"  # a stream's plain path must be a folder
    return spark.readStream.schema(schema).parquet(as_pattern).withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", "10 minutes")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there now and returns its result, written as tables of the shared folder: each batch appends
    its rows (append, update), or the last batch has them all (complete)."""
    spark = stream.sparkSession
    path = f"{table_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")  # one row
    return rows.drop("batch")


def counters_stream(events: DataFrame) -> DataFrame:
    """Totals by event type since the start (complete mode)."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 5).alias("errors"), F.max("value").alias("highest"))


def limit_stream(events: DataFrame, per_minute: int) -> DataFrame:
    return audit.over_limit(events, "user_id", "time", per_minute)


def accumulate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A run's state: events seen, the newest event's value, and its time. An hour's silence ends it as pending."""
    n, last, at, time = state.get if state.exists else (0, 0.0, -1, 0)
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"run_id": [key[0]], "n": [n], "last": [last], "status": ["pending"]})
        return
    for rows in batches:
        newest = rows.loc[rows["event_id"].idxmax()]
        n += len(rows)
        time = max(time, int(rows["millis"].max()))
        if newest["event_id"] > at:
            at, last = int(newest["event_id"]), float(newest["value"])
    state.update((n, last, at, time))
    state.setTimeoutTimestamp(max(time + SILENCE_MS, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"run_id": [key[0]], "n": [n], "last": [last], "status": ["open"]})


def run_states(events: DataFrame) -> DataFrame:
    """(run_id, n, last, status): a row whenever a run's state changes. Each run is a key of its own, its state four numbers."""
    rows = events.select(F.col("user_id").alias("run_id"), "event_id", "value", "time", F.unix_millis("time").alias("millis"))
    return rows.groupBy("run_id").applyInPandasWithState(accumulate, "run_id long, n long, last double, status string", "n long, last double, at long, time long", "update", GroupStateTimeout.EventTimeTimeout)


def append_json(stream: DataFrame, path: str, checkpoint: str):
    """The append-only log as JSON lines."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
