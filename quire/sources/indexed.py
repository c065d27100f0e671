"""A stored corpus with an index of three-byte sequences, so that a search reads few documents.

Documents lie in blocks, dealt by a hash of their name, each a partition folder of ``docs``; ``grams`` has, in
a folder a block, the distinct sequences of three bytes of its texts, letters A-Z in lower case. A text that holds a
literal has all sequences of it, so blocks that lack one are not read; in the others the usual search
runs, so no row depends on the index. Blocks are found by a query of the index, whose files are sorted by sequence.

In a search without regard to case, letters beyond ASCII may match other letters, and give no sequences. A literal
too short to have one is sought in all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import markdown
from quire.operators.keys import whole_documents
from quire.session import discard, materialize

BLOCKS = 256
_DOCS = "doc_stem string, markdown string, block int"
_GRAMS = "gram int, block int"
_STEP = 1 << 22  # bytes of a text looked at together
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_grams(raw: bytes) -> np.ndarray:
    """Distinct sequences of three bytes, as numbers."""
    values = np.frombuffer(raw.translate(_LOWER), np.uint8)
    seen = np.zeros(0, np.int32)
    for first in range(0, max(0, len(values) - 2), _STEP):
        part = values[first : first + _STEP + 2].astype(np.int32)
        seen = np.union1d(seen, part[:-2] << 16 | part[1:-1] << 8 | part[2:])
    return seen.astype(np.int32)


def literal_grams(query: str, case_sensitive: bool) -> list[int]:
    """Sequences that every text with a match has."""
    if case_sensitive:
        runs = [query]
    else:
        runs = "".join(c if c.isascii() else "\n\n\n" for c in query).split("\n\n\n")
    return sorted({g for run in runs for g in byte_grams(run.encode()).tolist()})


def _grams(docs: DataFrame) -> DataFrame:
    """gram, block of documents that have a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, text in zip(batch.column("block").to_pylist(), batch.column("markdown").to_pylist()):
                if text:
                    seen[block] = np.union1d(seen.get(block, np.zeros(0, np.int32)), byte_grams(text.encode()))
            if sum(map(len, seen.values())) > 1 << 22:
                yield from _rows(seen)
                seen = {}
        yield from _rows(seen)

    def _rows(seen: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for block, grams in seen.items():
            columns = [pa.array(grams.astype(np.int32)), pa.array(np.full(len(grams), block, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "block"])

    # Each task sends a sequence of a block once.
    return docs.select("block", "markdown").mapInArrow(run, _GRAMS).distinct()


def _write(docs: DataFrame, uri: str, dealt: bool = False) -> None:
    """Write blocks whole, and their sequences. ``docs`` is a table; ``dealt`` says that its files hold few blocks each."""
    spark = docs.sparkSession
    dynamic = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The index goes first: while the two differ, it may name blocks in vain, but leaves none out.
    grams = _grams(docs)  # where the texts lie; only sequences are moved
    if _exists(spark, f"{uri}/grams"):
        touched = docs.select("block").distinct()
        grams = grams.unionByName(_index(spark, uri).join(touched, "block", "left_semi")).distinct()
    dynamic(grams.repartition(tasks, "block").sortWithinPartitions("block", "gram")).parquet(f"{uri}/grams")
    dynamic(docs if dealt else docs.hint("rebalance", "block")).parquet(f"{uri}/docs")


def _exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _index(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.schema(_GRAMS).parquet(f"{uri}/grams")


def index_corpus(docs: DataFrame, uri: str, blocks: int = BLOCKS) -> None:
    """Store documents and their index at ``uri``, a new place. Take as many blocks as give texts of some 100 MB each."""
    block = F.pmod(F.xxhash64("doc_stem"), F.lit(blocks)).cast("int")
    # Made once, for the index and for the blocks.
    whole = materialize(whole_documents(docs).select("doc_stem", "markdown", block.alias("block")), "whole")
    _write(whole, uri)
    discard(whole)


def candidate_blocks(spark: SparkSession, uri: str, query: str, case_sensitive: bool = False) -> DataFrame | None:
    """``block`` of all blocks that may hold a match; None where the literal tells nothing."""
    grams = literal_grams(query, case_sensitive)
    if not grams:
        return None
    hits = _index(spark, uri).where(F.col("gram").isin(grams)).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == len(grams)).select("block")


def _candidates(spark: SparkSession, uri: str, query: str, case_sensitive: bool) -> DataFrame:
    docs = spark.read.schema(_DOCS).parquet(f"{uri}/docs")
    blocks = candidate_blocks(spark, uri, query, case_sensitive)
    # One row a block, a number that the corpus was stored with; known before the scan, it prunes partitions.
    return docs if blocks is None else docs.join(F.broadcast(blocks), "block")


def search_indexed(spark: SparkSession, uri: str, query: str, case_sensitive: bool = False) -> DataFrame:
    """``markdown.search_corpus`` over the stored corpus."""
    docs = _candidates(spark, uri, query, case_sensitive).select("doc_stem", "markdown")
    return markdown.search_corpus(docs, query, case_sensitive)


def replace_indexed(spark: SparkSession, uri: str, query: str, text: str, case_sensitive: bool = False) -> None:
    """Replace every match in the stored corpus; only blocks that hold one are written, whole, with their index.

    An index keeps the sequences that a replacement took away until its block is stored anew.
    """
    if not query:
        return
    pattern = F.lit(tx.literal_pattern(query, case_sensitive))
    hit = _candidates(spark, uri, query, case_sensitive).where(F.regexp_count("markdown", pattern) > 0)
    blocks = [r["block"] for r in hit.select("block").distinct().collect()]  # numbers of blocks
    if blocks:
        docs = spark.read.schema(_DOCS).parquet(f"{uri}/docs").where(F.col("block").isin(blocks))
        changed = docs.withColumn("markdown", markdown.replaced(F.col("markdown"), query, text, case_sensitive))
        # Written aside first: the blocks are read from where they are then replaced.
        aside = materialize(changed.select("doc_stem", "markdown", "block"), "replaced")
        _write(aside, uri, dealt=True)
        discard(aside)


def read_indexed(spark: SparkSession, uri: str) -> DataFrame:
    """The stored documents."""
    return spark.read.schema(_DOCS).parquet(f"{uri}/docs").drop("block")
