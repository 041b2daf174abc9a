"""Batch jobs as keyed state: progress as files finish, eviction by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .batch import KEEP_SECONDS

STATE = "total long, done long, errors long, skipped long, last long"
PROGRESS = "job_id string, total long, done long, errors long, skipped long, percent int, evicted boolean"


class JobState(StatefulProcessor):
    """Counts of a job and one timer, set anew by each of its events; a few numbers a job, however many files it has."""

    def __init__(self, keep_seconds: int, by_event_time: bool):
        self.keep_ms, self.by_event_time = keep_seconds * 1000, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", STATE)

    def _row(self, key, counts, evicted: bool) -> pd.DataFrame:
        total, done, errors, skipped = counts
        percent = int(done * 100 / total + 0.5) if total else 0
        return pd.DataFrame({"job_id": [key[0]], "total": [total], "done": [done], "errors": [errors], "skipped": [skipped], "percent": [percent], "evicted": [evicted]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, done, errors, skipped, last = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0)
        for part in rows:
            status = part["status"]
            waiting = int((status == "waiting").sum())
            total, done = total + waiting, done + len(status) - waiting
            errors, skipped = errors + int((status == "error").sum()), skipped + int((status == "skipped").sum())
            if self.by_event_time:
                last = max(last, int(part["ms"].max()))
        if not self.by_event_time:
            last = timerValues.getCurrentProcessingTimeInMs()
        self.counts.update((total, done, errors, skipped, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.keep_ms)
        yield self._row(key, (total, done, errors, skipped), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counts.exists():
            yield self._row(key, self.counts.get()[:4], True)
            self.counts.clear()

    def close(self) -> None:
        pass


def track_jobs(events: DataFrame, keep_seconds: int = KEEP_SECONDS, late: str | None = "10 minutes") -> DataFrame:
    """A stream of ``PROGRESS`` rows from (job_id, status, ts): one for each job in each batch that has events of it, and one when it is evicted.

    A file sends ``waiting`` when it is taken and done, error or skipped when it is finished; null status counts as finished, events without a job or time are left out. A job that
    hears nothing for ``keep_seconds`` is evicted with its last counts: by the events' own time, with ``late`` to wait for late ones, or by the clock where ``late`` is None. An event
    later than that is dropped with its time behind the watermark; one after eviction begins a job anew. Needs the RocksDB state store.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).filter("job_id is not null and ts is not null")
    rows = rows.withWatermark("ts", late) if late else rows
    rows = rows.selectExpr("cast(job_id as string) as job_id", "coalesce(status, 'done') as status", "ts", "unix_millis(ts) as ms")
    return rows.groupBy("job_id").transformWithStateInPandas(JobState(keep_seconds, late is not None), PROGRESS, "Append", "EventTime" if late else "ProcessingTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_jobs(events: DataFrame, out: str, checkpoint: str, keep_seconds: int = KEEP_SECONDS, late: str | None = "10 minutes") -> None:
    """Track the jobs of what a stream has by now, as Parquet rows in ``out``; state goes on from ``checkpoint``."""
    spark, name = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        progress = track_jobs(events, keep_seconds, late)
        progress.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
