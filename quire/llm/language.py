"""Language of a text by rank-order profiles of character n-grams.

Method. Texts are lower-cased, everything but letters is a word break, and words are padded by one
space. The n-grams of one to three characters of a language's texts, the most frequent
first, form its profile (``PROFILE`` n-grams; equal counts in order of the characters). A
text gets a profile the same way; its out-of-place distance to a language sums, over its
n-grams, how far their ranks lie apart, or ``PROFILE`` for one that the language lacks.
The nearest language wins; equal distances go to the first name.

Profiles count all training texts. Counts combine within each task before they are
shuffled; only the finished profiles reach the driver.

Edge cases. A null text, an empty one and one without a letter give ``und`` and score 0; so
does every text when nothing could be learned. Null languages teach nothing. Long texts
are read whole. Repeated rows stay. Columns of ``docs`` pass through, except ones named
``lang_pred`` or ``score``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import slices, texts_of, tidy

PROFILE = 300
UNKNOWN = "und"
BATCH_BYTES = 1 << 20
_MERGE_AT = 2_000_000
_BITS = np.uint64(21)  # of a code point; a gram is three of them, the missing ones 0


def letter_runs() -> np.ndarray:
    """Where letters begin and end among the code points, alternately."""
    flags = np.array([chr(c).isalpha() for c in range(0x110000)])
    return np.flatnonzero(np.diff(flags, prepend=False, append=False))


def letter_table(runs: np.ndarray) -> np.ndarray:
    flips = np.zeros(0x110001, np.int8)
    flips[runs] = 1
    return (np.cumsum(flips) & 1)[:-1].astype(bool)


def gram_counts(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, packed gram and count of each distinct n-gram of each text, in that order."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le"), np.uint32)
    is_letter = letters[points]
    points = np.where(is_letter, points, 0x20)
    used = np.flatnonzero(np.bincount(points))  # in order of code points, the space first
    base = len(used) + 1
    if base**3 * len(texts) >= 1 << 63 and len(texts) > 1:
        half = len(texts) // 2
        a, b = gram_counts(texts[:half], letters), gram_counts(texts[half:], letters)
        return np.r_[a[0], b[0] + half], np.r_[a[1], b[1]], np.r_[a[2], b[2]]
    code = np.zeros(int(used[-1]) + 1, np.uint64)
    code[used] = np.arange(1, base)
    symbols = code[points]
    lengths = np.fromiter(map(len, lowered), np.int64, len(texts)) + 1
    owner = np.zeros(len(points), np.uint64)
    owner[: lengths.sum()] = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    if len(texts):
        owner[lengths.sum() :] = len(texts) - 1
    keys = []
    n = len(points)
    b = np.uint64(base)
    one = symbols * b * b
    keys.append((owner * b * b * b + one)[is_letter])
    # A gram belongs to the text of its last letter: the space before a text is the one it shares
    # with the text before.
    if n > 1:
        valid = is_letter[:-1] | is_letter[1:]
        own = owner[1:].copy()
        own[~is_letter[1:]] = owner[:-1][~is_letter[1:]]
        keys.append((own * b * b * b + one[:-1] + symbols[1:] * b)[valid])
    if n > 2:
        valid = is_letter[1:-1]
        keys.append((owner[1:-1] * b * b * b + one[:-2] + symbols[1:-1] * b + symbols[2:])[valid])
    flat = np.concatenate(keys)
    flat.sort()
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(flat)])
    flat = flat[first]
    owners, gram = flat // (b * b * b), flat % (b * b * b)
    back = np.r_[0, used].astype(np.uint64)
    packed = back[gram // (b * b)] << (_BITS + _BITS)
    packed |= (back[gram // b % b] << _BITS) | back[gram % b]
    return owners.astype(np.int64), packed, counts


def _combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    grams = np.concatenate([g for g, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    some, place = np.unique(grams, return_inverse=True)
    return [(some, np.bincount(place, counts, len(some)).astype(np.int64))]


def profiles(docs: DataFrame, train_on: Column) -> dict[str, np.ndarray]:
    """Packed grams by language, most frequent first, from all rows where ``train_on`` holds."""
    runs = letter_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table(runs)
        held: dict[str, list] = {}
        for batch in tidy(batches):
            for part in slices(batch, BATCH_BYTES):
                langs = np.array(part.column(part.schema.get_field_index("lang")).to_pylist())
                owners, grams, counts = gram_counts(texts_of(part), letters)
                for lang in np.unique(langs).tolist():
                    mine = (langs == lang)[owners]
                    some = held.setdefault(lang, [])
                    some.append((grams[mine], counts[mine]))
                    if sum(len(g) for g, _ in some) > _MERGE_AT:
                        held[lang] = _combined(some)
        for lang, some in held.items():
            grams, counts = _combined(some)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts)],
                ["lang", "gram", "n"],
            )

    known = docs.where(train_on & F.col("lang").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    found: dict[str, list] = {}
    for row in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(row["lang"], []).append(row["gram"])
    return {lang: np.array(grams, np.uint64) for lang, grams in found.items()}


class Identifier:
    """Nearest profile of each text."""

    def __init__(self, known: dict[str, np.ndarray], letters: np.ndarray):
        self.letters, self.names = letters, sorted(known)
        self.sorted = []
        for name in self.names:
            order = np.argsort(known[name])
            self.sorted.append((known[name][order], order))

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        owners, grams, counts = gram_counts(texts, self.letters)
        n = len(texts)
        sizes = np.bincount(owners, minlength=n)
        # Most frequent first within a text; the sort is stable, so equal counts keep gram order.
        order = np.argsort(((owners + 1).astype(np.uint64) << np.uint64(40)) - counts.astype(np.uint64), kind="stable")
        owners, grams = owners[order], grams[order]
        ranks = np.arange(len(grams)) - np.repeat(np.r_[0, np.cumsum(sizes)][:-1], sizes)
        top = ranks < PROFILE
        owners, grams, ranks = owners[top], grams[top], ranks[top]
        shown = np.bincount(owners, minlength=n)
        apart = np.full((len(self.names) + 1, n), np.inf)
        for k, (profile, place) in enumerate(self.sorted):
            at = np.minimum(np.searchsorted(profile, grams), len(profile) - 1)
            away = np.where(profile[at] == grams, np.abs(place[at] - ranks), PROFILE)
            apart[k] = np.bincount(owners, away, n)
        best = apart.argmin(axis=0)
        known = (shown > 0) & (len(self.names) > 0)
        score = np.where(known, 1 - apart[best, np.arange(n)] / np.maximum(1, shown * PROFILE), 0.0)
        names = [*self.names, UNKNOWN]
        return [names[b] if k else UNKNOWN for b, k in zip(best, known)], score


def identify(docs: DataFrame, known: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (1: ranks agree wholly, 0: no n-gram in common)."""
    kept = docs.drop("lang_pred", "score")
    runs = letter_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Identifier(known, letter_table(runs))
        for batch in tidy(batches):
            for part in slices(batch, BATCH_BYTES):
                names, scores = nearest(texts_of(part))
                columns = [*part.columns, pa.array(names, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "lang_pred", "score"])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema, *fields]))
