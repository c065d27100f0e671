"""Helpers shared by the operators: tables, folds, Arrow batches and shared files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string")) % parts


def slices(batch: pa.RecordBatch, limit: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``limit`` text bytes each, one row at least.

    Arrays made from a run stay small whatever the size of Arrow's batches; only a
    single text that is longer makes a longer run.
    """
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0)).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory freed meanwhile goes back to the system after each.

    Workers are used again by later tasks, and the C library would keep their largest size.
    """
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        yield batch
        if trim is not None:
            trim(0)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """Texts of a batch; null is empty."""
    column = batch.column(batch.schema.get_field_index(text))
    return [t or "" for t in column.to_pylist()]


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Arrow lists from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def open_store(uri: str):
    """pyarrow file system and path of a Hadoop-style URI or local path."""
    from pyarrow import fs

    scheme = uri.split(":", 1)[0] if ":" in uri else ""
    if scheme in ("s3a", "s3n"):
        uri = "s3" + uri[len(scheme) :]
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if scheme else (fs.LocalFileSystem(), uri)


def fresh(name: str, suffix: str) -> str:
    """A file name that no other attempt of the task uses."""
    return f"{name}-{uuid.uuid4().hex}.{suffix}"


def bucketed(df: DataFrame, name: str, column: str, partition: list[str] | None = None) -> DataFrame:
    """A written table bucketed by a column, so that joins on it do not move its rows.

    There are as many buckets as shuffle partitions, else a join would deal it out anew.
    The files lie in the shared folder; only their frame is kept, not a table name.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table_name = f"quire_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets, column).option("path", new_folder(spark, name))
    (writer.partitionBy(*partition) if partition else writer).saveAsTable(table_name)
    return spark.table(table_name)


def pack_columns(*arrays: np.ndarray) -> bytes:
    """Columns of equal length, byte by byte and compressed."""
    import zstandard

    head = np.array([len(arrays[0]), *(a.itemsize for a in arrays)], np.int64).tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack_columns(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 * (1 + len(kinds)), []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, count * size, at).reshape(size, count)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += count * size
    return out
