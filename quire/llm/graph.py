"""Connected components by joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import discard, materialize


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id of ``edges`` (a, b: long, not null).

    Alternates large and small stars: every id links its larger, then its smaller neighbours to
    the smallest one, until only stars around the components' smallest ids are left. The
    rounds grow with the logarithm of the size; each is written, so lineage stays short.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "component-edges")
    before = None
    while (now := _checksum(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").unionByName(least.withColumnRenamed("m", "b")).distinct()
        older, edges = edges, materialize(small, "component-edges")
        discard(older)
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    centres = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    found = stars.unionByName(centres)
    found._quire_folder = edges._quire_folder  # what to discard when it is no more read
    return found
