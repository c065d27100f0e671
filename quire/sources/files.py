"""Sources: document files and the outputs of earlier runs."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.session import hadoop_path, materialize_counted

FILES = "path string, modificationTime timestamp, length bigint, content binary"
# A row holds less than 2 GiB. Larger files are read by their path (``extract.pages_in_ranges``).
LARGEST = 2_000_000_000
# What opening a file counts for when files are dealt over tasks. With Spark's own value a task has 32 files at most.
_OPEN_COST, _SPARKS_COST, _COST = "spark.sql.files.openCostInBytes", "4194304b", 32 << 10
# Tasks that look up the files of a read, at most. Spark's own value is one a folder, up to 10,000.
LOOKUPS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def file_stem(path) -> Column:
    """File name without its last extension, or ``document`` if nothing is left."""
    name = F.substring_index(path, "/", -1)
    stem = F.regexp_extract(name, r"\A(.+?)(?:\.[^.]*)?\z", 1)
    return F.when(stem == "", F.lit("document")).otherwise(stem)


def pdf_rows(files: DataFrame, max_bytes: int = LARGEST, size: str = "length") -> DataFrame:
    """File rows with their document name and ``error``.

    A file of more than ``max_bytes`` is a row without content that says so. ``size`` is the column that tells.
    """
    columns = [file_stem(F.col("path")).alias("doc_stem"), "path", "modificationTime", "length"]
    fits = F.col(size) <= max_bytes
    # Size is file metadata: with a filter on it alone, bytes of refused files are not read.
    taken = files.where(fits).select(*columns, "content", F.lit(None).cast("string").alias("error"))
    reason = F.concat(F.lit("file of "), "length", F.lit(f" bytes is over the limit of {max_bytes}"))
    refused = files.where(~fits).select(*columns, F.lit(None).cast("binary").alias("content"), reason.alias("error"))
    return taken.unionByName(refused)


def many_small(spark: SparkSession) -> None:
    """From now on the session deals small files over tasks by the hundred or thousand."""
    # Read when the scan is planned, which is after this, so it stays with the session. A value of the caller's is kept.
    if spark.conf.get(_OPEN_COST) == _SPARKS_COST:
        spark.conf.set(_OPEN_COST, str(_COST))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    many_small(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    return reader.option("pathGlobFilter", "*.pdf").load(path)


def ingest_files(spark: SparkSession, path: str, max_bytes: int = LARGEST) -> DataFrame:
    """PDF files of a folder (not below it), or one file, with their bytes.

    A file of more than ``max_bytes`` is an error row and the others are read.
    """
    # By the size that the listing tells, each of the two scans gets its own files only: most often one gets all of them.
    return pdf_rows(_listed(spark, path), max_bytes, "_metadata.file_size")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The same files without their bytes, of any size, to be opened by the tasks that read them.

    Small files are dealt by up to some thousands a task, fewer where there are fewer than that for each core.

    A folder of the ``file:`` system is listed by a task into a table in the shared folder, so the driver holds no file of
    it, however many there are. What lies in other stores, a pattern or a single file is listed by Spark at the
    driver, which then takes some kilobyte a file there.
    """
    many_small(spark)
    folder = _folder(spark, path)
    found = _listed_by_task(spark, folder) if folder else None
    found = _listed(spark, path) if found is None else found
    return found.select(file_stem(F.col("path")).alias("doc_stem"), "path", "modificationTime", "length")


def _folder(spark: SparkSession, path: str) -> str | None:
    """Plain name of a folder that any task can look into, or None if ``path`` is something else."""
    place, store = hadoop_path(spark, path)
    if store.getUri().getScheme() != "file" or any(c in path for c in "*?[]{}\\"):
        return None
    if not store.exists(place) or not store.getFileStatus(place).isDirectory():
        return None
    return store.makeQualified(place).toUri().getPath()


_ENTRY = "path string, modificationTime timestamp, length bigint, upto bigint"
_ENTRIES = 4096  # in a batch


def _listed_by_task(spark: SparkSession, folder: str) -> DataFrame | None:
    """``path, modificationTime, length`` of a folder's PDF files; None if Spark would look for partitions below it."""
    conf = spark._jsparkSession.sessionState().conf()
    opening, most = conf.filesOpenCostInBytes(), conf.filesMaxPartitionBytes()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from _entries(folder, opening, most)

    rows, seen = materialize_counted(
        spark.range(0, 1, 1, 1).mapInArrow(look, _ENTRY),
        "listed",
        upto=F.max("upto"),
        partitions=F.count_if(F.col("path").isNull()),
    )
    if seen["partitions"]:
        return None
    # As Spark deals files: at most so many bytes a task, opening a file counted as some, and less where cores would be idle.
    total = seen["upto"] or 0
    share = min(most, max(opening, total // spark.sparkContext.defaultParallelism, 1))
    tasks = max(1, -(-total // share))
    task = F.floor((F.col("upto") - 1) / F.lit(share)).cast("int")
    return rows.repartitionById(tasks, task).drop("upto")


def _entries(folder: str, opening: int, most: int) -> Iterator[pa.RecordBatch]:
    """Files of a folder as Spark lists them, some at a time; ``upto`` adds up what they count for.

    A folder that Spark takes for a partition is a row without a path.
    """
    schema = pa.schema(
        [("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("upto", pa.int64())]
    )
    rows, upto = [], 0
    with os.scandir(folder) as found:
        for entry in found:
            name = entry.name
            if name.startswith(".") or name.startswith("_") and "=" not in name:
                continue
            try:
                if entry.is_dir():
                    if "=" in name:
                        rows.append((None, None, None, None))
                elif name.endswith(".pdf"):
                    about = entry.stat()
                    if not about.st_size:
                        continue  # Spark passes over files without a byte
                    upto += min(about.st_size + opening, most)
                    path = f"file:{folder.rstrip('/')}/{name}".encode(errors="replace").decode()
                    rows.append((path, about.st_mtime_ns // 1_000_000 * 1000, about.st_size, upto))
            except FileNotFoundError:  # gone meanwhile, or a link to nowhere
                continue
            if len(rows) == _ENTRIES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass(frozen=True)
class Results:
    """Outputs read back."""

    documents: DataFrame
    catalog: DataFrame
    detections: DataFrame


def read_results(spark: SparkSession, path: str, layout: str = "parts") -> Results:
    """Markdown, catalogue and detections of earlier runs.

    ``parts`` is the folder layout of ``write_results``. ``flat`` is one folder of
    ``<stem>_enriched.md``, ``<stem>_images_metadata.json`` and ``<stem>_trash.json``
    files. JSON that cannot be read gives no catalogue or detection rows.
    """
    if layout == "flat":
        return _read_flat(spark, path)

    def texts(folder: str) -> DataFrame:
        # Keys come from the folder names of each file, so a kind without files is fine.
        reader = spark.read.option("recursiveFileLookup", "true")
        full = _decoded(F.col("_metadata.file_path"))
        return reader.text(f"{path}/{folder}", wholetext=True).select(
            _decoded(F.regexp_extract(full, "/doc_stem=([^/]*)/", 1)).alias("doc_stem"),
            # The text writer ends each file with a newline of its own.
            F.regexp_replace("value", r"\n\z", "").alias("value"),
        )

    before, few = spark.conf.get(LOOKUPS), 4 * spark.sparkContext.defaultParallelism
    try:
        # There is a folder a document, and files are looked up here, not when they are read.
        spark.conf.set(LOOKUPS, str(min(int(before), few)))
        return Results(
            texts("markdown").select("doc_stem", F.col("value").alias("markdown")),
            _json_rows(texts("images_metadata"), schemas.CATALOG),
            _json_rows(texts("trash"), schemas.DETECTIONS),
        )
    finally:
        spark.conf.set(LOOKUPS, before)


def _decoded(name: Column) -> Column:
    """Undo percent encoding, which leaves plus signs alone in paths."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _json_rows(texts: DataFrame, schema: str) -> DataFrame:
    fields = [f.strip() for f in schema.split(",")][1:]
    names = [f.split(" ")[0] for f in fields]
    rows = texts.select(
        "doc_stem", F.explode(F.from_json("value", f"array<struct<{','.join(f.replace(' ', ':') for f in fields)}>>")).alias("r")
    )
    return rows.where(F.col("r").isNotNull()).select("doc_stem", *[F.col(f"r.{n}").alias(n) for n in names])


def _read_flat(spark: SparkSession, path: str) -> Results:
    def texts(suffix: str) -> DataFrame:
        reader = spark.read.option("pathGlobFilter", f"*{suffix}")
        name = F.col("_metadata.file_name")
        return reader.text(path, wholetext=True).select(
            _decoded(F.substring(name, F.lit(1), F.length(name) - len(suffix))).alias("doc_stem"),
            "value",
        )

    return Results(
        texts("_enriched.md").select("doc_stem", F.col("value").alias("markdown")),
        _json_rows(texts("_images_metadata.json"), schemas.CATALOG),
        _json_rows(texts("_trash.json"), schemas.DETECTIONS),
    )
