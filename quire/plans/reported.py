"""Runs in waves of documents that report what they did as events.

Documents are dealt over waves by a hash of their name. The outputs of a wave are written, then its events, each step
once: a folder that a finished job wrote is not written again. A run that broke off goes on with the first wave
that has no events, and gives the events that it would have given.

Events are rows of the tables that the run wrote, so a task that runs again writes the same rows, and Spark's
commit shows them once. Their sequence numbers come from the page number: in a document, page p (from 0) begins at
``3 p + 1``, has an error at ``3 p + 2`` and is complete at ``3 p + 3``; the document starts at 0 and ends after
its last page. ``EVENTS`` is what ``streaming.progress`` reads, beside a message.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.keys import document_pages
from quire.plans.pipelines import Outputs
from quire.sources.sinks import write_tables

EVENTS = (
    "job_id string, seq bigint, ts timestamp, current_page int, total_pages int, new_images int, phase string, message string"
)


def _finished(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _event(seq: Column, current: Column, total: Column, images: Column, phase: str, message: Column) -> list[Column]:
    return [
        F.col("doc_stem").alias("job_id"),
        seq.cast("bigint").alias("seq"),
        F.current_timestamp().alias("ts"),
        current.cast("int").alias("current_page"),
        total.cast("int").alias("total_pages"),
        images.cast("int").alias("new_images"),
        F.lit(phase).alias("phase"),
        message.alias("message"),
    ]


def starting_events(pages: DataFrame) -> DataFrame:
    """One event a document, before its pages."""
    zero, message = F.lit(0), F.concat(F.lit("Starting: "), "doc_stem")
    return document_pages(pages).select(*_event(zero, zero, F.col("pages"), zero, "starting", message))


def page_events(pages: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """Begin and end of each page, with the images described on it, and one error of each page that had any.

    ``described`` has a row an image (``doc_stem, page_num, error``).
    """
    # Facts of a document are joined to its pages; the page rows have no text.
    rows = pages.select("doc_stem", "page_num").join(document_pages(pages), "doc_stem")
    zero, page, total = F.lit(0), F.col("page_num") + 1, F.col("pages")
    first = F.col("page_num") * 3 + 1
    of = lambda word: F.concat(F.lit(f"{word} page "), page.cast("string"), F.lit("/"), total.cast("string"))
    begun = rows.select(*_event(first, page, total, zero, "processing", of("Processing")))
    if described is None:
        return begun.unionByName(rows.select(*_event(first + 2, page, total, zero, "processing", of("Completed"))))
    asked = described.groupBy("doc_stem", "page_num").agg(
        F.count_if(F.col("error").isNull()).alias("images"), F.min("error").alias("problem")
    )
    rows = rows.join(asked, ["doc_stem", "page_num"], "left")
    images = F.coalesce("images", F.lit(0))
    ended = rows.select(*_event(first + 2, page, total, images, "processing", of("Completed")))
    told = F.concat(F.lit("Error on page "), page.cast("string"), F.lit(": "), "problem")
    failed = rows.where(F.col("problem").isNotNull())
    return begun.unionByName(ended).unionByName(failed.select(*_event(first + 1, page, zero, zero, "error", told)))


def complete_events(pages: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """One event a document, after its pages."""
    ends = pages.groupBy("doc_stem").agg(F.max("page_num").alias("last"))
    images = F.lit(0).cast("long")
    if described is not None:
        told = described.groupBy("doc_stem").agg(F.count_if(F.col("error").isNull()).alias("images"))
        ends = ends.join(told, "doc_stem", "left")
        images = F.coalesce("images", F.lit(0))
    zero = F.lit(0)
    message = F.concat(F.lit("Complete: "), "doc_stem", F.lit(" ("), images.cast("string"), F.lit(" images)"))
    return ends.select(*_event(F.col("last") * 3 + 4, zero, zero, zero, "complete", message))


def reported_run(
    pages: DataFrame, process: Callable[[DataFrame], Outputs], out: str, events: str, waves: int = 8
) -> dict[str, int]:
    """Process documents in waves, write each wave's tables below ``out`` and its events below ``events``.

    ``process`` takes pages and gives the outputs of a run, such as ``pipelines.text_only_pipeline``. Pages are
    written once, by wave, so an extractor is not called again. Returns counts taken from the events of all waves:
    documents, pages, page errors, images.
    """
    spark = pages.sparkSession
    store = f"{out}/pages"
    if not _finished(spark, store):
        # Before the tables of the waves; a run that goes on reads what the first one wrote.
        wave = F.pmod(F.xxhash64("doc_stem"), F.lit(waves)).cast("int")
        pages.withColumn("wave", wave).write.mode("overwrite").partitionBy("wave").parquet(store)
    kept = spark.read.schema(f"{pages._jdf.schema().toDDL()}, wave int").parquet(store)
    _write_once(starting_events(kept), f"{events}/starting")
    for number in range(waves):
        if _finished(spark, f"{events}/wave-{number}"):
            continue
        mine = kept.where(F.col("wave") == number).drop("wave")
        run = process(mine)
        write_tables(run.documents, run.catalog, run.detections, f"{out}/results/wave={number}")
        told = page_events(mine, run.described).unionByName(complete_events(mine, run.described))
        _write_once(told, f"{events}/wave-{number}")
    return run_counts(read_events(spark, events))


def _write_once(rows: DataFrame, folder: str) -> None:
    if not _finished(rows.sparkSession, folder):
        rows.write.mode("overwrite").parquet(folder)


def read_events(spark: SparkSession, events: str) -> DataFrame:
    return spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(events)


def stream_events(spark: SparkSession, events: str, max_files: int = 1000) -> DataFrame:
    """The events of a run as they come, for ``streaming.progress``."""
    reader = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", max_files).parquet(events)


def run_counts(events: DataFrame) -> dict[str, int]:
    """Documents, pages, page errors and images that the events tell of."""
    done = F.col("phase") == "processing"
    row = events.agg(
        F.count_if(F.col("phase") == "complete").alias("documents"),
        F.count_if(done & (F.col("seq") % 3 == 0)).alias("pages"),
        F.count_if(F.col("phase") == "error").alias("page_errors"),
        F.coalesce(F.sum("new_images"), F.lit(0)).alias("images"),
    ).first()
    return row.asDict()
