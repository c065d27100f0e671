"""Toxicity scores from averaged subword embeddings and a linear softmax.

Method. A text is the bag of distinct character n-grams of its lower-cased words, each padded
by a space. Every n-gram is hashed to a bucket with an embedding; the mean of a text's embeddings
and of ``PADDING`` zero vectors, which keep a text of few n-grams near the bias, goes through
a linear softmax. Embeddings and softmax are trained jointly by Adagrad
in numpy, so a misspelt word scores near the words it shares n-grams with. Since the
model is linear in the mean, a trained bucket needs one number when texts are scored:
what it adds to the difference of the two logits.

Training reads at most ``sample_rows`` labelled rows (the smallest by a hash of the id),
which bounds what reaches the driver: bucket numbers, never texts.

Edge cases. Null and empty texts have no n-gram and get the score of the bias alone. With no
labelled row of both kinds, every score is the share of label 1, or 0. A document with
several labels counts as toxic if any says so; null labels are ignored. Long texts
are scored whole. Repeated rows stay. Columns of ``docs`` pass through, except ones
named ``score``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import slices, texts_of, tidy

SIZES = (3, 4, 5)
BUCKET_BITS = 18
SAMPLE_ROWS = 4000
DIMENSIONS = 8
EPOCHS = 12
RATE = 0.5
MIN_TEXTS = 3
PADDING = 200
THRESHOLD = 0.7
BATCH_BYTES = 1 << 20
_BASE = 0x01000193


def ngram_buckets(texts: list[str], bits: int = BUCKET_BITS):
    """For each n-gram size: buckets by position, which positions hold an n-gram.

    Last, the position where each text starts; the final entry is the end.
    """
    lowered = [t.lower() for t in texts]
    joined = " " + " ".join(lowered) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    white = (points == 0x20) | ((points >= 9) & (points <= 13)) | (points == 0xA0)
    points[white] = 0x20
    lengths = np.fromiter(map(len, lowered), np.int64, len(texts)) + 1
    firsts = np.r_[0, np.cumsum(lengths)]
    n = len(points)
    found = []
    inner = np.ones(n, bool)
    hashes = points.copy()
    power = np.uint32(1)
    for size in range(2, max(SIZES) + 1):
        m = n - size + 1
        if m <= 0:
            break
        power = np.uint32((int(power) * _BASE) & 0xFFFFFFFF)
        hashes = hashes[:m] + points[size - 1 :] * power
        if size > 2:  # all but the two ends must be no white space
            inner = inner[:m] & ~white[size - 2 : n - 1]
        if size in SIZES:
            mixed = hashes ^ (hashes >> np.uint32(15))
            mixed = mixed * np.uint32(0x9E3779B1 + 2 * size)
            found.append((mixed >> np.uint32(32 - bits), inner))
    return found, firsts


def distinct_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, one text after the other, and their number by text."""
    found, firsts = ngram_buckets(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(firsts))
    keys = [
        (owner[: len(b)][v[: len(owner)]] << np.uint64(BUCKET_BITS)) | b[: len(owner)][v[: len(owner)]]
        for b, v in found
    ]
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    if len(texts) >> (32 - BUCKET_BITS) == 0:  # narrow keys sort faster
        keys = keys.astype(np.uint32)
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    sizes = np.bincount((keys >> BUCKET_BITS).astype(np.int64), minlength=len(texts))
    return (keys & ((1 << BUCKET_BITS) - 1)).astype(np.int64), sizes


@dataclass
class Model:
    """What each bucket adds to the logit of label 1, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        buckets, sizes = distinct_buckets(texts)
        total = np.bincount(np.repeat(np.arange(len(texts)), sizes), self.weights[buckets], len(texts))
        logit = self.bias + total / (sizes + PADDING)
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def bags(docs: DataFrame) -> DataFrame:
    """doc_id, label, and the distinct buckets of a text as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for part in slices(batch, BATCH_BYTES):
                buckets, sizes = distinct_buckets(texts_of(part))
                own = np.split(buckets.astype("<i4"), np.cumsum(sizes)[:-1])
                place = part.schema.get_field_index
                columns = [part.column(place(c)) for c in ("doc_id", "label")] + [pa.array([b.tobytes() for b in own])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "label", "text").mapInArrow(run, f"doc_id {kind}, label int, ids binary")


def calibrate(design: np.ndarray, bias: float, labels: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Factors of the columns that, with the bias, fit the labels best.

    Newton steps, halved until the loss falls: where the logits are far apart the curve is flat,
    and a full step would leave the data behind.
    """
    start = np.array([1.0, 0.0])

    def loss(fit: np.ndarray) -> float:
        z = design @ fit + bias
        return float(np.logaddexp(0, z).sum() - labels @ z + ridge / 2 * ((fit - start) ** 2).sum())

    fit, now = start.copy(), loss(start)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ fit + bias, -60, 60)))
        slope = design.T @ (p - labels) + ridge * (fit - start)
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        while (new := loss(fit - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if now - new < 1e-9:
            break
        fit, now = fit - step, new
    return fit


def train(bags_: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Joint training on four fifths of the bags; the rest sets scale and shift of the weights.

    The bias is the logit of the share of label 1, so that a text without n-grams scores that share.
   """
    kept_out = np.arange(len(labels)) % 5 == 4
    learn, hold = np.flatnonzero(~kept_out).tolist(), np.flatnonzero(kept_out).tolist()
    model = _train([bags_[i] for i in learn], labels[learn], seed)
    if len(set(labels[learn].tolist())) < 2 or len(set(labels[hold].tolist())) < 2:
        return model
    design = np.array([[model.weights[bags_[i]].sum(), len(bags_[i])] for i in hold])
    design /= (design[:, 1] + PADDING)[:, None]
    factor, shift = calibrate(design, model.bias, labels[hold])
    return Model((model.weights * factor + shift).astype(np.float32), model.bias)


def _train(bags_: list[np.ndarray], labels: np.ndarray, seed: int) -> Model:
    """Joint training of embeddings and softmax on bags of buckets."""
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(weights, 60.0 if share else -60.0)
    # A bucket of a single text tells nothing of others; its number is a shared last one.
    times = np.zeros(1 << BUCKET_BITS, np.int32)
    for bag in bags_:
        times[bag] += 1  # a bag names a bucket once
    used = np.flatnonzero(times >= MIN_TEXTS)
    place = np.full(1 << BUCKET_BITS, len(used), np.int32)
    place[used] = np.arange(len(used))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (len(used) + 1, DIMENSIONS)).astype(np.float32)
    embed[-1] = 0
    softmax = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    embed_g, softmax_g = np.full(len(used) + 1, 1e-8, np.float32), np.full((DIMENSIONS, 2), 1e-8)
    target = np.eye(2, dtype=np.float32)[labels]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            cols = np.concatenate([place[bags_[i]] for i in some])
            sizes = np.array([len(bags_[i]) for i in some])
            share_of = np.repeat(1 / (sizes + PADDING), sizes).astype(np.float32)
            row = np.repeat(np.arange(len(some)), sizes)
            mean = np.empty((len(some), DIMENSIONS), np.float32)
            for k in range(DIMENSIONS):
                mean[:, k] = np.bincount(row, embed[cols, k] * share_of, len(some))
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - target[some]) / len(some)
            back = error @ softmax.T  # gradient of the means
            grad = mean.T @ error
            softmax_g += grad**2
            softmax -= (rate * grad / np.sqrt(softmax_g)).astype(np.float32)
            uniq, inv = np.unique(cols, return_inverse=True)
            step = np.stack(
                [np.bincount(inv, back[row, k] * share_of, len(uniq)) for k in range(DIMENSIONS)], axis=1
            ).astype(np.float32)
            embed_g[uniq] += (step**2).sum(axis=1)
            embed[uniq] -= rate * step / np.sqrt(embed_g[uniq])[:, None]
            embed[-1] = 0
    weights[used] = embed[:-1] @ (softmax[:, 1] - softmax[:, 0])
    return Model(weights, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, train_on: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from the labelled rows where ``train_on`` (over labels' doc_id) holds.

    The sample is bounded by ``sample_rows`` and so may be broadcast to the documents.
    """
    known = labels.where(train_on & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # In a fixed order, so that the same rows always give the same model.
    got = bags(rows).toArrow().sort_by([("doc_id", "ascending"), ("ids", "ascending")])
    ids = [np.frombuffer(b.as_buffer(), "<i4") for b in got["ids"]]  # views, not copies
    return train(ids, np.clip(np.asarray(got["label"]), 0, 1))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, from the text alone."""
    kept = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for part in slices(batch, BATCH_BYTES):
                scores = pa.array(model.scores(texts_of(part)))
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("score", T.DoubleType())]))
