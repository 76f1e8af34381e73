"""Runs as streams of updates: each update adds to its run's trace and overwrites the fields it names, until the run ends."""

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SILENCE_MS = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

UPDATES = "run_id long, event_id long, time timestamp, node string, fields map<string,string>, ends boolean"
OUT = "run_id long, began long, n long, trace string, fields map<string,string>, status string"
NAMES = [c.split()[0] for c in OUT.split(", ")]


@contextmanager
def state_store(spark: SparkSession):
    """While this lasts streams are started with the state store that lists, values and timers need."""
    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if own is None else spark.conf.set(PROVIDER, own)


class RunState(StatefulProcessor):
    """A list of what has been traced, a value for each field, the run's times, and a timer for its silence.

    A run ends as done with an update that says so, or as pending when nothing has come for silence_ms: by the next update's
    time where one comes, else by the watermark. Its one row is made then and its state goes; what comes later is a new run.
    """

    def __init__(self, silence_ms: int = SILENCE_MS):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trace = handle.getListState("trace", "node string")
        self.fields = handle.getMapState("fields", "name string", "value string")
        self.times = handle.getValueState("times", "began long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """State is asked once for what an earlier batch has left, and told once what this one leaves: each call goes to Spark and
        back. A run that begins and ends in a batch has none."""
        (run,) = key
        began, last = self.times.get() or (None, None)
        known = kept = began is not None  # kept: trace and fields are in state
        ended, nodes, fields = [], [], {}

        def end(status: str) -> None:
            nonlocal kept
            ended.append(self._row(run, began, nodes, fields, status, kept))
            kept = False

        batch = list(rows)
        batch = batch[0] if len(batch) == 1 else pd.concat(batch)
        batch = batch.iloc[np.lexsort((batch["event_id"], batch["millis"]))]
        for millis, node, named, ends in zip(*(batch[c].tolist() for c in ("millis", "node", "fields", "ends"))):
            if began is not None and millis - last > self.silence_ms:
                end("pending")
                began, nodes, fields = None, [], {}
            began = millis if began is None else began
            last = max(millis, last or millis)
            nodes.append(node)
            fields.update(dict(named or {}))
            if ends:
                end("done")
                began, last, nodes, fields = None, None, [], {}
        for timer in list(self.handle.listTimers()) if known else []:
            self.handle.deleteTimer(timer)
        if began is not None:
            if nodes:
                self.trace.appendList([(x,) for x in nodes])
            for name, value in fields.items():
                self.fields.updateValue((name,), (value,))
            self.times.update((began, last))
            self.handle.registerTimer(last + self.silence_ms)
        elif known:
            self.times.clear()
        if ended:
            yield pd.DataFrame(ended, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        times = self.times.get()
        if times:
            row = self._row(key[0], times[0], [], {}, "pending", True)
            self.times.clear()
            yield pd.DataFrame([row], columns=NAMES)

    def _row(self, run, began: int, nodes: list, fields: dict, status: str, kept: bool) -> tuple:
        """The run's row, of what this batch has of it and, if an earlier batch has kept some, its trace and fields, which go."""
        if kept:
            nodes = [x[0] for x in self.trace.get()] + nodes
            fields = {k[0]: v[0] for k, v in self.fields.iterator()} | fields
            self.trace.clear()
            self.fields.clear()
        return run, began, len(nodes), ">".join(nodes), fields, status

    def close(self) -> None:
        pass


def ended_runs(updates: DataFrame, silence_ms: int = SILENCE_MS) -> DataFrame:
    """updates: a stream of (run_id, event_id, time, node, fields, ends) with a watermark on time -> one row for each run that
    has ended: began (ms), n, trace (its nodes in order), fields (each one's last value), status (done or pending).

    Updates of a batch are taken in order of time and event_id. A null in fields is a value; a null `fields` names none.
    """
    rows = updates.select("run_id", "event_id", "time", "node", "fields", "ends", F.unix_millis("time").alias("millis"))
    return rows.groupBy("run_id").transformWithStateInPandas(RunState(silence_ms), OUT, "Append", "EventTime")
