"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Method. Vectors are centred on the mean and scaled to length one. A random rotation, made from a
seed, spreads them evenly; the signs of the rotated coordinates are the code, packed into bytes.
With it go two scalars: the distance to the mean and the inner product of the unit
vector with its own code. A query is rotated too and rounded at random to ``QUERY_BITS``
bits a coordinate, so that its inner product with a code is a sum of bit counts. Divided
by the code's own scalar this estimates the inner product of the unit vectors without
bias, with an error of about ``sqrt((1 - s * s) / (s * s * (d - 1)))``; ``EPSILON`` of
these bound the distance from below. Vectors whose lower bound does not exceed the k-th
smallest distance found so far are ranked again by the exact distance, in double precision
on the original vectors.

Every query meets every vector's code: blocks of queries are sent to as many partitions as
hold vectors, and joined there with the blocks of vectors by partition number. A pair of
blocks yields ``k`` rows a query, and the best of these are merged per query.

Edge cases. Vectors that are null, zero, or hold a null or a number that is not finite take no
part, nor do those whose length is not the most common one (ties: the longer). With fewer
candidates than ``k`` all are returned; none but the query itself gives no row. Ties go to
the smaller id. A row is no neighbour of rows of its own id; repeated ids besides that
stay. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20240917
EPSILON = 4.0
QUERY_BITS = 6
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 256


def usable(vectors: DataFrame) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    v = F.col("vector")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, finite))
    kept = kept.where(F.exists(v, lambda x: x != 0))
    sizes = kept.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size"))
    common = sizes.limit(1).collect()
    return kept.where(F.size(v) == (common[0]["size"] if common else 0))


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """Orthogonal matrix, uniform over all."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, distances to the mean, and inner products of unit vectors with their codes."""
    centred = vectors - mean
    length = np.linalg.norm(centred, axis=1)
    unit = (centred / np.where(length > 0, length, 1)[:, None]) @ turn
    return np.packbits(unit > 0, axis=1), length, np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])


class Queries:
    """Rotated queries as planes of bits."""

    def __init__(self, vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray):
        centred = vectors - mean
        self.length = np.linalg.norm(centred, axis=1)
        unit = (centred / np.where(self.length > 0, self.length, 1)[:, None]) @ turn
        self.low = unit.min(axis=1)
        self.step = np.maximum((unit.max(axis=1) - self.low) / ((1 << QUERY_BITS) - 1), 1e-12)
        place = (unit - self.low[:, None]) / self.step[:, None]
        shake = np.random.default_rng(SEED + 1).random(unit.shape)
        level = np.clip(np.floor(place + shake), 0, (1 << QUERY_BITS) - 1).astype(np.uint8)
        self.sum = level.sum(axis=1, dtype=np.int64)
        self.planes = [np.packbits((level >> b) & 1, axis=1) for b in range(QUERY_BITS)]

    def inner_products(self, i: int, codes: np.ndarray, ones: np.ndarray, own: np.ndarray, d: int) -> np.ndarray:
        """Estimated inner products of unit query ``i`` with the coded unit vectors."""
        bits = np.zeros(len(codes), np.int64)
        for b, plane in enumerate(self.planes):
            bits += np.bitwise_count(codes & plane[i]).sum(axis=1, dtype=np.int64) << b
        # A coordinate of a code is 1/sqrt(d) or its negative.
        rounded = self.step[i] * (2 * bits - self.sum[i]) + self.low[i] * (2 * ones - d)
        return rounded / np.sqrt(d) / own


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, coded: tuple, mean: np.ndarray,
    turn: np.ndarray, k: int,
) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Query ids, vector ids and exact distances of the ``k`` nearest in one block."""
    codes, length, own = coded
    d = vectors.shape[1]
    own = np.where(own > 0, own, 1.0)
    spread = EPSILON * np.sqrt(np.maximum(1 - own**2, 0) / (own**2 * max(d - 1, 1)))
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    asked = Queries(queries, mean, turn)
    out: tuple[list, list, list] = ([], [], [])
    for i in range(len(query_ids)):
        near = np.minimum(asked.inner_products(i, codes, ones, own, d) + spread, 1.0)
        both = 2 * length * asked.length[i]
        low = np.maximum(length**2 + asked.length[i] ** 2 - both * near, 0)
        low[ids == query_ids[i]] = np.inf
        order = np.argsort(low, kind="stable")[: int(np.isfinite(low).sum())]
        best_ids, best = np.zeros(0, ids.dtype), np.zeros(0)
        at, width = 0, max(4 * k, 64)
        while at < len(order):  # by rising lower bound, until it exceeds the k-th distance
            some = order[at : at + width]
            if len(best) >= k:
                some = some[low[some] <= best[k - 1] ** 2 * (1 + 1e-9) + 1e-12]
                if not len(some):
                    break
            gap = vectors[some] - queries[i]
            exact = np.sqrt((gap * gap).sum(axis=1))
            best_ids, best = np.r_[best_ids, ids[some]], np.r_[best, exact]
            keep = np.lexsort((best_ids, best))[:k]
            best_ids, best = best_ids[keep], best[keep]
            at += width
        out[0].append(np.full(len(best), query_ids[i]))
        out[1].append(best_ids)
        out[2].append(best)
    return out


def _blocks(rows: DataFrame, size: int, mean: np.ndarray, turn: np.ndarray | None) -> DataFrame:
    """Rows packed into blocks as bytes; with codes if ``turn`` is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(mean)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors = np.asarray(part.column(1).flatten(), float).reshape(-1, d)
                columns = [np.asarray(part.column(0)).tobytes(), vectors.tobytes()]
                names = ["ids", "vectors"]
                if turn is not None:
                    columns += [x.tobytes() for x in encode(vectors, mean, turn)]
                    names += ["codes", "lengths", "own"]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names)

    fields = "ids binary, vectors binary" + ", codes binary, lengths binary, own binary" * (turn is not None)
    return rows.mapInArrow(run, fields)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), id, score: the ``k`` nearest rows of each query row.

    ``vectors`` has id (long) and vector; ``is_query`` is a condition on id.
    """
    rows = usable(vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")))
    means = rows.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    mean = np.array([r["m"] for r in sorted(means.collect(), key=lambda r: r["i"])])
    schema = "query_id long, rank int, id long, score double"
    if not len(mean):
        return vectors.sparkSession.createDataFrame([], schema)
    turn = rotation(len(mean))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = _blocks(rows, BLOCK_VECTORS, mean, turn)
    coded = coded.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    asked = _blocks(rows.where(is_query), BLOCK_QUERIES, mean, None)
    asked = asked.select(
        F.col("ids").alias("query_ids"),
        F.col("vectors").alias("queries"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    pairs = asked.join(coded, "part").drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(mean)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                wide = -(-d // 8)
                found = search_block(
                    np.frombuffer(row["query_ids"], np.int64),
                    np.frombuffer(row["queries"]).reshape(-1, d),
                    ids,
                    np.frombuffer(row["vectors"]).reshape(-1, d),
                    (
                        np.frombuffer(row["codes"], np.uint8).reshape(-1, wide),
                        np.frombuffer(row["lengths"]),
                        np.frombuffer(row["own"]),
                    ),
                    mean,
                    turn,
                    k,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in found], ["query_id", "id", "score"]
                )

    found = pairs.mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
