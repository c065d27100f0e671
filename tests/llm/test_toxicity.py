import random

import numpy as np

from pyspark.sql import functions as F
from quire.llm import toxicity

from .conftest import EDGES


def corpus(spark, n=600):
    rng = random.Random(4)
    plain = ["river", "stone", "morning", "quiet", "table", "window", "garden", "letter", "paper", "winter"]
    bad = ["wretchedfool", "vileidiot", "filthyscum"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) + rng.choice(["", "s", "ly"]) for _ in range(80)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(5):
                words[rng.randrange(80)] = rng.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_and_misspelt_words(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels, F.col("doc_id") < 450)
    held = docs.where("doc_id >= 450").join(labels, "doc_id")
    rows = toxicity.score(held, model).collect()
    assert sum((r.score >= 0.7) == bool(r.toxic) for r in rows) > 0.97 * len(rows)
    filler = "river stone morning quiet table window garden letter " * 5
    misspelt = model.scores([filler + "wretchedfoool vilejdiot filthyscumm wretchdfool", filler])
    assert misspelt[0] > 0.7 > 0.3 > misspelt[1]


def test_edges(spark, edges, empty):
    docs, labels = corpus(spark, 120)
    odd = labels.union(spark.createDataFrame([(None, 1), (1, None), (0, 0)], "doc_id long, toxic int"))
    model = toxicity.fit(docs, odd, F.lit(True))
    rows = toxicity.score(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if not (r.text or "").strip()}
    assert len(blank) == 1 and max(blank) < 0.7
    assert toxicity.score(empty, model).count() == 0
    one_kind = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert one_kind.scores(["anything"])[0] < 1e-6
    assert toxicity.fit(docs, labels.limit(0), F.lit(True)).scores([""])[0] < 1e-6


def test_sample_is_bounded(spark, monkeypatch):
    docs, labels = corpus(spark, 90)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda bags, labels: seen.append(len(bags)))
    toxicity.fit(docs, labels, F.lit(True), sample_rows=25)
    assert seen == [25]


def test_calibration_stays_with_the_data():
    # Logits far apart: a full Newton step would leap to factors of millions.
    rng = np.random.default_rng(1)
    labels = (rng.random(800) < 0.1).astype(int)
    sums = np.where(labels == 1, 8.0, -15.0) + rng.normal(0, 5, 800)
    design = np.stack([sums, rng.uniform(0.3, 1, 800)], axis=1)
    factor, shift = toxicity.calibrate(design, -2.2, labels)
    p = 1 / (1 + np.exp(-(design @ [factor, shift] - 2.2)))
    assert 0 < factor < 50 and abs(shift) < 50
    assert abs(p.mean() - labels.mean()) < 0.02 and ((p >= 0.7) == labels).mean() > 0.97


def test_most_of_a_corpus_is_kept(spark):
    # A model that has gone astray rejects nearly everything, whatever its held-out score order.
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    for rest in (1, 2):
        model = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != rest)
        rejected = toxicity.score(docs, model).agg(F.avg((F.col("score") >= 0.7).cast("int"))).collect()[0][0]
        assert 0.02 < rejected < 0.15


def test_training_holds_little_beside_its_bags():
    import tracemalloc

    rng = np.random.default_rng(3)
    bags = [np.unique(rng.integers(0, 1 << toxicity.BUCKET_BITS, 4000).astype("<i4")) for _ in range(600)]
    labels = (np.arange(600) % 3 == 0).astype(int)
    tracemalloc.start()
    toxicity.train(bags, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Sorting the buckets of all bags together took 77 MB.
    assert peak < 50e6
