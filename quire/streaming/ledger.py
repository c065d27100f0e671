"""The job ledger kept up to date by batches of updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.jobs import ENDED, ledger_row
from quire.streaming.folded import EVERY, Folded

_FIELDS = ("status", "progress", "result", "error")
_PARTIAL = (
    "job_id string, "
    + ", ".join(f"{f} struct<seq:bigint,value:string>" for f in _FIELDS)
    + ", created struct<seq:bigint,ts:timestamp>, updated struct<seq:bigint,ts:timestamp>"
    + ", started struct<seq:bigint,ts:timestamp>, completed struct<seq:bigint,ts:timestamp>"
)


def ledger_partials(events: DataFrame) -> DataFrame:
    """What a batch of updates says of each job: each field's last value and time with their ``seq``.

    All parts are minima and maxima, so partials merge in any order, and merging one twice changes nothing.
    """
    seq, at = F.col("seq"), F.struct("seq", "ts")
    hit = lambda *statuses: F.when(F.col("status").isin(*statuses), at)
    values = [F.max(F.when(F.col(f).isNotNull(), F.struct(seq, F.col(f).alias("value")))).alias(f) for f in _FIELDS]
    return events.groupBy("job_id").agg(
        *values,
        F.min(at).alias("created"),
        F.max(at).alias("updated"),
        F.max(hit("processing")).alias("started"),
        F.max(hit(*ENDED)).alias("completed"),
    )


def _merged(partials: DataFrame) -> DataFrame:
    last = [*_FIELDS, "updated", "started", "completed"]
    return partials.groupBy("job_id").agg(*[F.max(c).alias(c) for c in last], F.min("created").alias("created")).select(
        *[f.strip().split(" ")[0] for f in ("job_id", *_FIELDS, "created", "updated", "started", "completed")]
    )


def _table(spark: SparkSession, uri: str, every: int = EVERY) -> Folded:
    return Folded(spark, uri, _PARTIAL, _merged, every)


def fold_updates(events: DataFrame, uri: str, batch_id: int, every: int = EVERY) -> None:
    """Add a batch of ``job_events`` to the ledger at ``uri``; reads nothing but the batch.

    Every so many batches the updates since the last snapshot are merged into a new one. A batch that
    is given again changes nothing.
    """
    _table(events.sparkSession, uri, every).add(ledger_partials(events), batch_id)


def read_ledger(spark: SparkSession, uri: str) -> DataFrame:
    """Current row of each job, as ``jobs.latest_job_state`` gives it from all updates."""
    rows = _table(spark, uri).read()
    values = [F.col(f"{f}.value").alias(f) for f in _FIELDS]
    times = {"created_at": "created", "updated_at": "updated", "started_at": "started", "completed_at": "completed"}
    return ledger_row(rows.select("job_id", *values, *[F.col(f"{c}.ts").alias(n) for n, c in times.items()]))


def stream_ledger(
    events: DataFrame, uri: str, checkpoint: str, trigger: dict | None = None, every: int = EVERY
) -> StreamingQuery:
    """Follow a stream of job updates; ``read_ledger`` gives the current rows."""
    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: fold_updates(batch, uri, number, every))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
