"""A job's feed by keyed state: one flag per ended job, cleared by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quire.functions import fixed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Ends(StatefulProcessor):
    """Remembers where a job ended, until the time for it is over."""

    def __init__(self, phases: list[str], retention_ms: int):
        self.phases, self.retention_ms = phases, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("ended_seq", "ended_seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.end.get()
        ended = known[0] if known is not None else None
        # The rows of one job in one batch; where it ends must be known before any goes out.
        parts = list(rows)
        terminal = [p.loc[p["phase"].isin(self.phases), "seq"].min() for p in parts]
        first = min((int(s) for s in terminal if s == s), default=None)
        if first is not None and (ended is None or first < ended):
            if ended is None:
                now = max(timerValues.getCurrentWatermarkInMs(), max(int(p["ts"].max().timestamp() * 1000) for p in parts))
                self.handle.registerTimer(now + self.retention_ms)
            ended = first
            self.end.update((ended,))
        for part in parts:
            yield part if ended is None else part[part["seq"] <= ended]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.end.clear()
        return iter(())

    def close(self) -> None:
        pass


def terminal_feed(events: DataFrame, delay: str, retention_ms: int, terminal_phases: list[str] | None = None) -> DataFrame:
    """A stream's rows up to the first terminal row of each job, by state of each job.

    ``events`` has ``job_id, seq, phase, ts``. Rows over ``delay`` behind the newest event are dropped. The
    flag of an ended job goes ``retention_ms`` of event time after its end, so state is as large as the jobs that ended
    lately; rows of a job that come within that time are left out. All rows of a job in a batch meet in one
    task: for jobs that may have very many, ``progress.stream_terminal`` spreads them.
    """
    phases = list(terminal_phases or fixed.TERMINAL_PHASES)
    return (
        events.withWatermark("ts", delay)
        .groupBy("job_id")
        .transformWithStateInPandas(_Ends(phases, retention_ms), events.schema, "Append", "EventTime")
    )


def stream_terminal_keyed(
    events: DataFrame,
    out: str,
    checkpoint: str,
    delay: str = "10 minutes",
    retention_ms: int = 86_400_000,
    terminal_phases: list[str] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """``terminal_feed`` written as Parquet files below ``out``; state lives in RocksDB beside the checkpoint."""
    events.sparkSession.conf.set(_PROVIDER, ROCKSDB)
    return (
        terminal_feed(events, delay, retention_ms, terminal_phases)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
