"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Adaptive execution picks partition counts, splits skewed join partitions and turns
# joins into broadcasts once a side's real size is known to be small.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Gathering page texts of many blocks at once turns to sorting sooner.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "32",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int = 8, **extra: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is named."""
    named = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(
        _CHECKPOINT_DIR, None
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quire-")
    spark.conf.set(_CHECKPOINT_DIR, own)
    return own


def hadoop_path(spark: SparkSession, uri: str) -> tuple:
    """Hadoop's path object of a folder or file, and the file system that it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tidy_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one, in which shuffle files go as soon as their query ends.

    Otherwise they stay until the driver happens to collect its garbage, which fills disks in a run that goes on for long.
    Queries of such a session that are run twice shuffle twice.
    """
    shared_dir(spark)
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(_CLEANUP, "true")
    return own


def materialize(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where rows must not be computed twice, such as answers of a model. The
    table survives the loss of executors, and reads of it are column-pruned. With ``by``, it is
    written in as many buckets as there are shuffle partitions, so joins and groups on these columns do not move it.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    if by:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        listed = f"quire_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets, *by).option("path", path).saveAsTable(listed)
        table = spark.table(listed)
    else:
        df.write.parquet(path)
        table = spark.read.schema(df.schema).parquet(path)
    table._quire_folder = path
    return table


def discard(table: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once every table made from it is written."""
    path, store = hadoop_path(table.sparkSession, table._quire_folder)
    store.delete(path, True)


def materialize_counted(
    df: DataFrame, name: str, by: list[str] | None = None, **metrics: Column
) -> tuple[DataFrame, dict]:
    """``materialize``, with aggregates observed while the table is written."""
    seen = Observation()
    named = [column.alias(key) for key, column in metrics.items()]
    return materialize(df.observe(seen, *named), name, by), seen.get
