import math

import numpy as np
from pyspark.sql import functions as F
from quire.llm import ann


def brute(rows, is_query, k):
    out = {}
    for q, v in rows:
        if is_query(q):
            near = sorted((math.dist(v, w), i) for i, w in rows if i != q)[:k]
            out[q] = [i for _, i in near]
    return out


def test_recall_against_all_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 48)) * 2
    rows = [(i, (centres[i % 8] + rng.normal(size=48)).tolist()) for i in range(1500)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    got = {}
    for r in ann.nearest(frame, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    want = brute(rows, lambda i: i % 50 == 0, 10)
    hits = sum(len(set(want[q]) & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.99 * 10 * len(want)
    vectors = dict(rows)
    assert all(abs(s - math.dist(vectors[q], vectors[i])) < 1e-12 for q in got for i, s in got[q])


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    data = rng.normal(size=(3000, 64))
    turn, mean = ann.rotation(64), data.mean(axis=0)
    codes, length, own = ann.encode(data, mean, turn)
    asked = ann.Queries(data[:40], mean, turn)
    unit = (data - mean) / length[:, None]
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    spread = np.sqrt((1 - own**2) / (own**2 * 63))
    error = np.stack([asked.inner_products(i, codes, ones, own, 64) - unit @ unit[i] for i in range(40)])
    assert abs(error.mean()) < 0.002 and (np.abs(error) > ann.EPSILON * spread).mean() < 1e-3


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [5.0, 5.0]), (None, [1.0, 1.0]), (3, [0.0, 2.0]),
    ]
    frame = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("part", F.lit("x"))
    got = ann.nearest(frame, F.col("id") % 2 == 0, 10).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 9)))
    assert sorted(by) == [0, 2, 10]
    apart = round(math.sqrt(5), 9)
    assert by[0] == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, apart), (4, 3, apart), (5, 10, round(math.sqrt(41), 9))]
    assert ann.nearest(frame.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(frame.where("id = 0"), F.lit(True)).count() == 0
