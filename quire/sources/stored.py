"""Output tables laid out by a hash of the document, so that a change touches few files.

Every table (``markdown``, ``images_metadata``, ``trash``, ...) lies in ``buckets`` partition folders. Saving
documents again, or purging them, reads and rewrites only the partitions that hold them, each by one job whose
commit replaces whole partitions; files of the others are not touched. Both may run again after a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.session import discard, materialize

BUCKETS = 256
_BUCKET = "bucket"
_WORD = 62  # partitions whose marks fit a whole number


def bucket_of(doc_stem: str | Column = "doc_stem", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(doc_stem), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, uri: str) -> bool:
    path, store = _path(spark, uri)
    return store.exists(path)


def read_stored(spark: SparkSession, uri: str, table: str, schema: str) -> DataFrame:
    """A stored table, with ``bucket`` as its last column."""
    return spark.read.schema(f"{schema}, {_BUCKET} int").parquet(f"{uri}/{table}")


def _replace(kept: DataFrame, place: str, touched: list[int]) -> None:
    """Make ``kept`` all that the touched partitions hold.

    Rows are dealt by partition, and a partition too large for a task is written by several, as several files.
    """
    spark = kept.sparkSession
    words = range(0, max(touched, default=0) + 1, _WORD)
    # Which partitions get rows, one bit each, is seen while they are written.
    bit = F.when(F.col(_BUCKET).isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.col(_BUCKET) % _WORD))
    marks = [F.bit_or(F.when(F.floor(F.col(_BUCKET) / _WORD) == w // _WORD, bit)).alias(f"w{w}") for w in words]
    seen = Observation()
    spread = kept.hint("rebalance", _BUCKET).observe(seen, *marks)
    writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(_BUCKET).parquet(place)
    found = seen.get
    for number in touched:
        if not (found[f"w{number - number % _WORD}"] or 0) >> number % _WORD & 1:  # nothing was written there, so nothing was replaced
            path, store = _path(spark, f"{place}/{_BUCKET}={number}")
            store.delete(path, True)


def save_documents(tables: dict[str, DataFrame], uri: str, ids: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Save rows of documents; what the tables held of these documents before is replaced.

    ``ids`` lists the documents (``doc_stem``), by default all that occur in any of the tables. Other documents stay.
    The list is written aside once; each table is then made once, as it is written.
    """
    if ids is None:
        stems = [t.select("doc_stem") for t in tables.values()]
        ids = stems[0]
        for more in stems[1:]:
            ids = ids.unionByName(more)
    listed = materialize(ids.select("doc_stem").distinct().withColumn(_BUCKET, bucket_of(buckets=buckets)), "saved")
    touched = [r[0] for r in listed.select(_BUCKET).distinct().collect()]
    for name, table in tables.items():
        place, rows = f"{uri}/{name}", table.withColumn(_BUCKET, bucket_of(buckets=buckets))
        if _exists(table.sparkSession, place):
            old = read_stored(table.sparkSession, uri, name, table._jdf.schema().toDDL())
            old = old.where(F.col(_BUCKET).isin(touched)).join(listed.select("doc_stem"), "doc_stem", "left_anti")
            rows = old.unionByName(rows)
        _replace(rows, place, touched)
    discard(listed)


def purge_stored(spark: SparkSession, uri: str, schemas: dict[str, str], ids: DataFrame, buckets: int = BUCKETS) -> dict[str, int]:
    """Remove the documents in ``ids`` from every stored table; returns the rows removed from each.

    ``schemas`` names the tables. ``buckets`` is the number they were saved with.
    """
    gone = materialize(ids.select("doc_stem").distinct(), "purged")
    touched = [r[0] for r in gone.select(bucket_of(buckets=buckets).alias("b")).distinct().collect()]
    removed = {}
    for name, schema in schemas.items():
        place = f"{uri}/{name}"
        if not touched or not _exists(spark, place):
            removed[name] = 0
            continue
        rows = read_stored(spark, uri, name, schema).where(F.col(_BUCKET).isin(touched))
        counts = rows.join(gone, "doc_stem", "left_semi").groupBy(_BUCKET).count().collect()  # a row a partition
        removed[name] = sum(r["count"] for r in counts)
        hit = [r[_BUCKET] for r in counts]
        if hit:
            _replace(rows.where(F.col(_BUCKET).isin(hit)).join(gone, "doc_stem", "left_anti"), place, hit)
    discard(gone)
    return removed
