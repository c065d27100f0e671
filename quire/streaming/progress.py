"""Streams: job progress, the end of a job's feed, and arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions import fixed
from quire.operators import enrich
from quire.plans import pipelines
from quire.session import discard, hadoop_path, tidy_session
from quire.sources.files import FILES, LARGEST, LOOKUPS, many_small, pdf_rows
from quire.sources.sinks import place_parts, write_tables
from quire.streaming.folded import EVERY, Folded
from quire.streaming.waiting import Waiting, WaitingQuery


def progress_state(events: DataFrame) -> DataFrame:
    """Latest progress and images so far per job; works on a batch or a stream.

    All parts combine before the shuffle, so one busy job does not weigh on a task.
    """
    return _progress_partials(events).drop("last_ts")


def _progress_partials(events: DataFrame) -> DataFrame:
    """Progress of some events, with the time of the last one; null where events have none."""
    time = (F.col("ts") if "ts" in events.columns else F.lit(None)).cast("timestamp")
    latest = F.max_by(F.struct("seq", "current_page", "total_pages", "phase"), "seq")
    parts = events.groupBy("job_id").agg(
        latest.alias("latest"), F.sum("new_images").alias("images_processed"), F.max(time).alias("last_ts")
    )
    return parts.select("job_id", "latest.*", "images_processed", "last_ts")


_PARTIAL = (
    "job_id string, seq bigint, current_page int, total_pages int, phase string, images_processed bigint, last_ts timestamp"
)


def _merged_progress(partials: DataFrame) -> DataFrame:
    fields = ["seq", "current_page", "total_pages", "phase"]
    return partials.groupBy("job_id").agg(
        F.max_by(F.struct(*fields), "seq").alias("latest"),
        F.sum("images_processed").alias("images_processed"),
        F.max("last_ts").alias("last_ts"),
    ).select("job_id", "latest.*", "images_processed", "last_ts")


def _progress_table(spark: SparkSession, out: str, every: int = EVERY, retention: str | None = None) -> Folded:
    idle = (lambda newest: F.col("last_ts") < newest - F.expr(f"INTERVAL {retention}")) if retention else None
    return Folded(spark, out, _PARTIAL, _merged_progress, every, "last_ts", idle)


def stream_progress(
    events: DataFrame,
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
    every: int = EVERY,
    retention: str | None = None,
) -> StreamingQuery:
    """Follow a progress stream; ``read_progress`` gives the state of each job.

    The stream itself has no state: each batch writes the progress of its own rows, and these
    are merged when read and, every so many batches, in a snapshot. With ``retention`` (an interval such as
    ``1 DAY``), a job without a row for so long before the newest one (by ``ts``), ended or not, leaves the snapshot
    for the archive. A later row of it is added to what the archive has.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        _progress_table(batch.sparkSession, out, every, retention).add(_progress_partials(batch), batch_id)

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_progress(spark: SparkSession, out: str, archived: bool = True) -> DataFrame:
    """Current row of each job from what ``stream_progress`` wrote; without ``archived``, of those of late alone."""
    return _progress_table(spark, out).read(settled=archived).drop("last_ts")


def feed_until_terminal(events: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows up to and including the one that ended their job (``job_id, ended_seq``)."""
    return (
        events.join(ends, "job_id", "left")
        .where(F.col("ended_seq").isNull() | (F.col("seq") <= F.col("ended_seq")))
        .drop("ended_seq")
    )


def first_terminal(events: DataFrame, terminal_phases: list[str]) -> DataFrame:
    """``job_id, ended_seq, ended_ts``: the first terminal row of each job; the time is null where events have none."""
    time = (F.col("ts") if "ts" in events.columns else F.lit(None)).cast("timestamp")
    return (
        events.where(F.col("phase").isin(terminal_phases))
        .groupBy("job_id")
        .agg(F.min("seq").alias("ended_seq"), F.min_by(time, "seq").alias("ended_ts"))
    )


_ENDS = "job_id string, ended_seq bigint, ended_ts timestamp"


def _merged_ends(ends: DataFrame) -> DataFrame:
    return ends.groupBy("job_id").agg(F.min("ended_seq").alias("ended_seq"), F.max("ended_ts").alias("ended_ts"))


def stream_terminal(
    events: DataFrame,
    out: str,
    checkpoint: str,
    terminal_phases: list[str] | None = None,
    trigger: dict | None = None,
    snapshot_every: int = EVERY,
    retention: str | None = None,
) -> StreamingQuery:
    """Feed of progress rows that ends, per job, at its first terminal row.

    State is one number per ended job, kept as a table beside the feed: each batch
    adds the jobs it ended and joins its rows with all ends so far. Both are plain
    aggregates and joins, so the rows of one busy job are spread over tasks, and a
    batch that is run again replaces its own folders. Rows of a job that come after
    its end, in this or any later batch, are left out.

    With ``retention``, an interval such as ``1 DAY``, the end of a job is forgotten when it is so much older (by
    ``ts``) than the newest end, so the table stays as large as the ends of that time. Rows that come
    later than that are let through.
    """
    phases = terminal_phases or fixed.TERMINAL_PHASES
    old = (lambda newest: F.col("ended_ts") < newest - F.expr(f"INTERVAL {retention}")) if retention else None

    def save(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # The source is read once; the ends and the feed read what it gave.
        batch.write.mode("overwrite").parquet(f"{out}/arrived")
        arrived = session.read.schema(batch.schema).parquet(f"{out}/arrived")
        table = Folded(session, f"{out}/ends", _ENDS, _merged_ends, snapshot_every, "ended_ts", old, keep=False)
        table.add(first_terminal(arrived, phases), batch_id)
        feed = feed_until_terminal(arrived, table.read().drop("ended_ts"))
        feed.write.mode("overwrite").parquet(f"{out}/feed/batch_id={batch_id}")

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


_CODEC = "spark.sql.parquet.compression.codec"
_COMPACTION = "spark.sql.streaming.fileSource.log.compactInterval"


def stream_ingest(
    spark: SparkSession,
    folder: str,
    out: str,
    extractor: Callable,
    checkpoint: str,
    language: str = "th",
    max_bytes: int = LARGEST,
    max_files: int = 1000,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Process PDF files of a folder as they arrive, without a model.

    Each batch of files is written as tables in a folder of its own; a batch that is run again replaces it. The stream's
    checkpoint remembers which files are done. A batch itself extracts its pages. The text-only run, whose cost hardly
    depends on a batch's few files, is made for all batches that wait for it at the same time (``streaming.waiting``),
    so the tables of a batch may come after the stream has gone on. The query that is returned ends when all are written.
    The files of a batch are looked up by at most as many tasks as there are cores and read by few, and the source's
    list of all files so far is written anew every 100 batches instead of ten; these settings stay with the session, as the
    source asks for them at every batch. Tables are written with zstd where no other codec than Spark's own is set.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("pathGlobFilter", "*.pdf")
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )

    staged = f"{out}/_staged"

    def extract(batch: DataFrame, batch_id: int) -> None:
        # Extraction runs caller code once; everything else reads its table.
        pages = enrich.pages_from_documents(batch, extractor)
        pages.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}/pages", compression=codec)
        waiting.add(batch_id)

    def process(batches: list[int]) -> None:
        extracted = own.read.schema(enrich.PAGES).parquet(*[f"{out}/batch_id={n}/pages" for n in batches])
        run = pipelines.text_only_pipeline(_named(extracted), language, keep_pages=True, title=_own_name())
        tables = {n: _owned(t) for n, t in zip(_TABLES, (run.documents, run.catalog, run.detections))}
        if len(batches) == 1:
            write_tables(*[t.drop("batch_id") for t in tables.values()], f"{out}/batch_id={batches[0]}")
        else:
            write_tables(*tables.values(), staged, by="batch_id")
            for name, table in tables.items():
                place_parts(table, f"{staged}/{name}", "batch_id", {n: f"{out}/batch_id={n}/{name}" for n in batches})
        for table in run.written:
            discard(table)

    def stored(batch_id: int) -> int:
        path, store = hadoop_path(spark, f"{out}/batch_id={batch_id}/pages")
        return store.getContentSummary(path).getLength()

    cores = spark.sparkContext.defaultParallelism
    if int(spark.conf.get(LOOKUPS)) > cores:
        spark.conf.set(LOOKUPS, str(cores))
    many_small(spark)
    if spark.conf.get(_COMPACTION) == "10":
        spark.conf.set(_COMPACTION, "100")
    codec = "zstd" if spark.conf.get(_CODEC) == "snappy" else spark.conf.get(_CODEC)
    own = tidy_session(spark)
    own.conf.set(_CODEC, codec)
    waiting = Waiting(spark, out, process, stored)
    waiting.recover(checkpoint)
    query = (
        # By the size that the listing tells, a file is looked at once and one that is refused is not read.
        pdf_rows(files, max_bytes, "_metadata.file_size")
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(extract)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    return WaitingQuery(query, waiting)


_TABLES = ("markdown", "images_metadata", "trash")
# While several batches are one run, a document's name follows the number of its batch: two may have one of the same name.
_DIGITS = 20


def _named(extracted: DataFrame) -> DataFrame:
    number = F.regexp_extract(F.col("_metadata.file_path"), r".*/batch_id=([0-9]+)/pages/[^/]*\z", 1)
    return extracted.withColumn("doc_stem", F.concat(F.lpad(number, _DIGITS, "0"), F.lit("/"), "doc_stem"))


def _own_name() -> Column:
    return F.expr(f"substring(doc_stem, {_DIGITS + 2})")


def _owned(table: DataFrame) -> DataFrame:
    return table.withColumns({"batch_id": F.substring("doc_stem", 1, _DIGITS).cast("long"), "doc_stem": _own_name()})
