"""The fold of a job's events with keyed state and timers.

Each job has a map from key to its last status, sequence number and number of events, one entry for each key in the state
store, so a batch reads and writes the entries of the keys that occur in it, however many the job has. When the event comes
that ends a job, a timer is set; when event time is ``keep_seconds`` past it, the job's state is cleared.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strataquill.streaming.events import ENDED, FOLDED

#: The store that Spark's keyed state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def store(spark: SparkSession) -> Iterator[None]:
    """Sets the store for the streams that are started inside."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


class JobFold(StatefulProcessor):
    def __init__(self, keep_seconds: int, ended: tuple[str, ...]):
        self.keep_ms, self.ended = keep_seconds * 1000, ended

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "key string", "status string, seq long, n_events long")
        self.end = handle.getValueState("ended", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        found: dict[str, tuple] = {}
        end = self.end.get()[0] if self.end.exists() else None
        was = end
        for b in rows:
            for name, seq, status, at in zip(b["key"].tolist(), b["seq"].tolist(), b["status"].tolist(), b["at"].tolist(), strict=True):
                best = found.get(name)
                found[name] = (status, seq, 1) if best is None else (*((status, seq) if seq > best[1] else best[:2]), best[2] + 1)
                if name == "job" and status in self.ended:
                    end = max(end or 0, int(at.timestamp() * 1000))
        out = []
        for name, (status, seq, n) in found.items():
            if self.last.containsKey((name,)):
                held = self.last.getValue((name,))
                status, seq, n = *((status, seq) if seq > held[1] else held[:2]), n + held[2]
            self.last.updateValue((name,), (status, seq, n))
            out.append((str(key[0]), name, status, seq, n, end is not None))
        if end is not None and end != was:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.end.update((end,))
            self.handle.registerTimer(max(end + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        self.end.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_jobs(events: DataFrame, keep_seconds: int = 600, lateness: str = "10 seconds", ended: tuple[str, ...] = ENDED) -> DataFrame:
    """The latest status of each key of a job (job_id, key, seq, status, at: timestamp) as a stream, in update mode; a row comes
    out for each key that a batch has events of. To be started inside :func:`store`."""
    rows = events.select("job_id", "key", F.col("seq").cast("long"), "status", "at").withWatermark("at", lateness)
    return rows.groupBy("job_id").transformWithStateInPandas(JobFold(keep_seconds, ended), FOLDED, "Update", "eventTime")


def latest_of(updates: DataFrame) -> DataFrame:
    """The last row of each job and key of what a stream has put out (batch, job_id, key, ...)."""
    last = updates.groupBy("job_id", "key").agg(F.max_by(F.struct("status", "seq", "n_events", "ended"), "batch").alias("x"))
    return last.select("job_id", "key", "x.*")
