"""Sinks: result folders, bundles, published files and request rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import text as tx
from quire.operators.images import image_groups_html
from quire.operators.keys import whole_documents
from quire.session import hadoop_path
from quire.sources.staged import delete_files, delete_paths, open_target, write_files


def _json_rows(table: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One JSON array per document: ``doc_stem, value, n``, with ``[]`` for those of ``names`` that have no row.

    Names meet the rows in the one grouping, so the table is made once.
    """
    rows = table.select("doc_stem", F.struct(*[c for c in table.columns if c != "doc_stem"]).alias("row"))
    if names is not None:
        rows = rows.unionByName(names.select("doc_stem"), allowMissingColumns=True)
    listed = F.to_json(F.sort_array(F.collect_list("row")))
    return rows.groupBy("doc_stem").agg(listed.alias("value"), F.count("row").alias("n"))


def _kind(rows: DataFrame, folder: str, replacing: bool | Column = False) -> DataFrame:
    """``doc_stem, value`` rows as rows of the file sink."""
    return rows.select(F.lit(folder).alias("folder"), "doc_stem", "value", F.lit(replacing).alias("replacing"))


def _write_kinds(rows: DataFrame, uri: str, *kinds: str) -> dict[str, int]:
    """Write files of several kinds, all or none; returns how many of each, without those only replaced."""
    seen = Observation()
    own = ~F.col("replacing")
    counts = [F.count_if(own & (F.col("folder") == k)).alias(k) for k in kinds]
    write_files(rows.sparkSession, rows.observe(seen, *counts), uri, kinds)
    return seen.get


def write_results(docs: DataFrame, catalog: DataFrame, det: DataFrame, uri: str) -> dict[str, int]:
    """Write Markdown, catalogue and detections of every document below ``uri``.

    ``uri`` is any Hadoop path (``file:``, ``s3a:``, a mount). Every document gets one
    Markdown file and a catalogue, ``[]`` when it has no images; detections only if
    there are any, or ``[]`` in place of earlier ones. Outputs of other documents stay, and are not looked at.
    All files of a write appear together: one that fails leaves what was there.
    Returns how many files of each kind were written, without replaced detections.

    Files and folders are one per document; ``stored.save_documents`` suits very many documents.
    """
    rows = whole_documents(docs).select("doc_stem", F.col("markdown").alias("value"))
    files = (
        _kind(rows, "markdown")
        .unionByName(_kind(_json_rows(catalog, rows), "images_metadata"))
        .unionByName(_kind(_json_rows(det, rows), "trash", replacing=F.col("n") == 0))
    )
    return _write_kinds(files, uri, "markdown", "images_metadata", "trash")


def purge_results(ids: DataFrame, uri: str) -> int:
    """Remove the files that ``write_results`` wrote of the documents in ``ids``; returns how many."""
    return delete_files(ids, uri, ["markdown", "images_metadata", "trash"])


def purge_jobs(jobs: DataFrame, uploads: str, uri: str) -> dict[str, int]:
    """Remove what jobs (``id, filename``) left behind; returns how many of each kind there were.

    These are the uploaded file ``<id>.pdf`` below ``uploads``, and below ``uri`` the results of the document and its
    pictures in ``images/<name>``. Names that would lead elsewhere are passed over.
    """
    stem = F.regexp_replace("filename", r"\.pdf\z", "")
    ids = jobs.select(stem.alias("doc_stem")).distinct()
    single = ~F.contains(stem, F.lit("/")) & (stem != "")  # never the folder of all pictures
    return {
        "uploads": delete_paths(jobs.select(F.concat("id", F.lit(".pdf")).alias("path")), uploads),
        "results": purge_results(ids, uri),
        "images": delete_paths(jobs.where(single).select(F.concat(F.lit("images/"), stem).alias("path")), uri),
    }


def write_tables(docs: DataFrame, catalog: DataFrame, det: DataFrame, uri: str, by: str | None = None) -> None:
    """Write the same outputs as Parquet tables, in place of all that ``uri`` held.

    The tables are written at the same time, as small ones take longer to plan than to write. With ``by``, each has a
    folder for each value of that column, of few files.
    ``stored.save_documents`` replaces only the documents at hand.
    """
    tables = {"markdown": docs, "images_metadata": catalog, "trash": det}

    def write(name: str) -> None:
        rows = tables[name].hint("rebalance", by) if by else tables[name]
        rows.write.mode("overwrite").parquet(f"{uri}/{name}", partitionBy=by)

    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(inheritable_thread_target(docs.sparkSession)(write), tables))


def place_parts(table: DataFrame, uri: str, by: str, targets: dict[int, str]) -> None:
    """Move the folders of a table that ``write_tables`` wrote ``by`` a number to places of their own, in place of all there.

    A number without a row has a table without rows.
    """
    spark = table.sparkSession
    _, store = hadoop_path(spark, uri)
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = {s.getPath().getName() for s in store.listStatus(path(uri))}
    bare = path(f"{uri}/bare")
    if any(f"{by}={n}" not in there for n in targets):
        columns = StructType([f for f in table.schema if f.name != by])
        spark.createDataFrame([], columns).write.mode("overwrite").parquet(bare.toString())
    for n, target in targets.items():
        place, part = path(target), path(f"{uri}/{by}={n}")
        store.delete(place, True)
        store.mkdirs(place.getParent())
        if f"{by}={n}" not in there:
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(
                store, bare, store, place, False, spark._jsc.hadoopConfiguration()
            )
        elif not store.rename(part, place):
            raise OSError(f"{part.toString()} cannot be moved to {target}")
        else:
            store.create(path(f"{target}/_SUCCESS"), True).close()


def export_bundle(
    docs: DataFrame,
    catalog: DataFrame,
    jobs: DataFrame,
    uri: str,
    base_url: str | None = None,
) -> dict[str, int]:
    """Bundle of completed jobs: Markdown, catalogue and list of image files, all or none of them.

    With ``base_url``, image tags become HTML. The image list comes from the catalogue.
    """
    done = (
        jobs.where(F.col("status") == "completed")
        .select(F.regexp_replace("filename", r"\.pdf\z", "").alias("doc_stem"))
        .distinct()
    )
    # Names of jobs are hashed, so that no task sorts texts to find its own.
    done = done.hint("shuffle_hash")
    chosen = docs.join(done, "doc_stem", "left_semi")
    if base_url:
        chosen = image_groups_html(chosen, base_url)
    images = catalog.join(done, "doc_stem", "left_semi")
    names = F.array_join(F.sort_array(F.collect_list("image_file")), "\n")
    listed = images.groupBy("doc_stem").agg(names.alias("value"))
    rows = whole_documents(chosen).select("doc_stem", F.col("markdown").alias("value"))
    catalogs = (
        rows.select("doc_stem")
        .join(_json_rows(images), "doc_stem", "full")
        .withColumn("value", F.coalesce("value", F.lit("[]")))
    )
    files = _kind(rows, "markdown").unionByName(_kind(catalogs, "metadata")).unionByName(_kind(listed, "images"))
    return _write_kinds(files, uri, "markdown", "metadata", "images")


_BATCH_SIZE, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


@dataclass(frozen=True)
class Published:
    """Outcome of publishing to one target."""

    target: str
    written: int
    failed: int
    error: str | None = None


def markdown_files(docs: DataFrame) -> DataFrame:
    """Files to publish, one per document: ``name, content``."""
    return whole_documents(docs).select(
        F.concat("doc_stem", F.lit(".md")).alias("name"), F.col("markdown").cast("binary").alias("content")
    )


def publish_files(files: DataFrame, uri: str) -> Published:
    """Copy ``name, content`` rows to files below ``uri`` and report counts.

    Every task writes its own rows; writing a name again replaces the file, so a
    repeated task does no harm. A file that cannot be written is counted and the
    others go on. Rows come to Python ``_BATCH_BYTES`` at a time, or one, however many a task has.
    """

    conf = files.sparkSession.conf
    before = conf.get(_BATCH_SIZE)
    written, failed = (files.sparkSession.sparkContext.accumulator(0) for _ in range(2))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base, problem, folders = None, "", None, set()
        try:
            target, base = open_target(uri)  # once a task; one that cannot be opened fails its rows, not the job
        except Exception as err:
            problem = str(err)
        for batch in batches:
            errors: list[str | None] = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                wrong = problem
                if wrong is None:
                    try:
                        path = f"{base}/{name}"
                        folder = path.rsplit("/", 1)[0]
                        if folder not in folders:
                            target.create_dir(folder, recursive=True)
                            folders.add(folder)
                        with target.open_output_stream(path) as out:
                            out.write(content.as_buffer())  # as it lies in the batch, without a copy
                    except Exception as err:
                        wrong = str(err)
                errors.append(wrong)
            written.add(errors.count(None))
            failed.add(len(errors) - errors.count(None))
            yield pa.RecordBatch.from_arrays([pa.array(errors, pa.string())], names=["error"])

    try:
        conf.set(_BATCH_SIZE, str(_BATCH_BYTES))
        outcome = files.select("name", "content").mapInArrow(copy, "error string")
        total = outcome.agg(
            F.count_if(F.col("error").isNull()).alias("written"),
            F.count("error").alias("failed"),
            F.max("error").alias("error"),
        ).first()
    except Exception as err:
        # The job broke off; what the tasks that ended reported still counts.
        return Published(uri, written.value, failed.value, str(err))
    finally:
        conf.set(_BATCH_SIZE, before)
    return Published(uri, total["written"], total["failed"], total["error"])


def publish_all(targets: list[tuple[DataFrame, str]]) -> list[Published]:
    """Publish to several targets; one that fails does not stop the others."""
    return [publish_files(files, uri) for files, uri in targets]


def _payload(target: str, ids: dict[str, Any]) -> tuple[str, Column]:
    text = F.col("markdown")
    if target == "flowise":
        loader = F.struct(
            F.lit("plainText").alias("loader"),
            F.struct(text.alias("text")).alias("loaderConfig"),
        )
        body = F.struct(F.array(loader).alias("docLoaders"))
        return f"/api/v1/document-store/upsert/{ids['store_id']}", body
    if target == "anythingllm":
        body = F.struct(
            text.alias("textContent"),
            F.struct(F.col("doc_stem").alias("title")).alias("metadata"),
            F.array(F.lit(ids["workspace"])).alias("addToWorkspaces"),
        )
        return "/api/v1/document/raw-text", body
    raise ValueError(f"unknown target {target!r}: use flowise or anythingllm")


def publish_payloads(
    docs: DataFrame,
    target: str,
    sender: Callable[[str, str], int] | None = None,
    base_url: str = "",
    image_base_url: str | None = None,
    **ids: str,
) -> DataFrame:
    """Request rows for an HTTP target: ``doc_stem, url, body``.

    ``flowise`` needs ``store_id`` and ``anythingllm`` needs ``workspace``. With
    ``image_base_url``, image tags become HTML first. With a ``sender``, which takes
    address and body and returns the HTTP status, each row is sent and ``ok``,
    ``status`` and ``error`` are added.
    """
    path, body = _payload(target, ids)
    whole = whole_documents(docs)
    source = image_groups_html(whole, image_base_url) if image_base_url else whole
    keys = ["doc_stem"]
    requests = source.select(
        *keys, F.lit(base_url.rstrip("/") + path).alias("url"), F.to_json(body).alias("body")
    )
    if sender is None:
        return requests

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status: list[int | None] = []
            errors: list[str | None] = []
            for row in batch.select(["url", "body"]).to_pylist():
                try:
                    status.append(int(sender(row["url"], row["body"])))
                    errors.append(None)
                except Exception as err:
                    status.append(None)
                    errors.append(str(err))
            ok = [s is not None and 200 <= s < 300 for s in status]
            named = [batch.column(k) for k in [*keys, "url"]]
            yield pa.RecordBatch.from_arrays(
                [*named, pa.array(ok), pa.array(status, pa.int32()), pa.array(errors, pa.string())],
                names=[*keys, "url", "ok", "status", "error"],
            )

    typed = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return requests.mapInArrow(send, f"{typed}, url string, ok boolean, status int, error string")


def public_image_urls(catalog: DataFrame, base: str, prefix: str = "") -> DataFrame:
    """Public address and MIME type of every catalogued image."""
    return catalog.select(
        "doc_stem",
        "image_file",
        tx.public_url(base, F.col("image_file"), prefix).alias("url"),
        tx.mime_type(F.col("image_file")).alias("content_type"),
    )
