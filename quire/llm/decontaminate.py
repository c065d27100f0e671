"""Benchmark passages in documents, found by spaced seeds and verified with substitutions.

Method. Words are runs of letters and digits in lower case. Each mask of ``MASKS`` selects some
positions of a window of words and ignores the others, so that a substituted word hides a
passage only from the windows that select it. The hashes of all windows of the benchmark
form an index; windows of documents are looked up, through a bitmap first. A hit lays a
benchmark item along the document; on this line any stretch of which ``SIMILARITY`` of the
words are equal, and at least ``MIN_MATCHED`` (of a shorter item: ``SIMILARITY`` of all its words),
is an overlap. The one of most equal words is reported, from an equal word to an equal word.

The index is sent to every task. Its size is bounded: a benchmark of more than
``INDEX_WINDOWS`` windows is split by item, and the documents pass through one index after
the other. Documents are never shuffled.

Edge cases. Null and empty texts, on either side, overlap with nothing, nor do items of fewer than
``SHORTEST`` words. Items of equal text or id are reported each; a document and an item
give the best overlap only (most equal words, then the first place). Rows repeat as in
``docs``. A null item id is reported as null. Columns of ``docs`` pass through, except one
named ``leaks``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import slices, texts_of, tidy
from quire.llm.words import Hasher, windows

# 1 selects a position.
MASKS = ("11111", "110111", "1101011", "11010011", "101001011")
MIN_MATCHED = 8
SHORTEST = 5
SIMILARITY = 0.8
PENALTY = 4  # of another word, when an equal one counts 1: none is left over at SIMILARITY
INDEX_WINDOWS = 2_000_000
BITMAP_BITS = 23
BATCH_BYTES = 1 << 20

_OFFSETS = [tuple(i for i, c in enumerate(mask) if c == "1") for mask in MASKS]
_LEAKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("doc_start", T.IntegerType()),
            T.StructField("item_start", T.IntegerType()),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("n_matched", T.IntegerType()),
        ]
    ),
    False,
)


class Index:
    """Windows of benchmark items by hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], hasher: Hasher):
        self.ids = [i for i, _ in items]
        hashes, counts = hasher([t or "" for _, t in items])
        self.words = np.split(hashes, np.cumsum(counts)[:-1]) if len(items) else []
        found = []
        for item, words in enumerate(self.words):
            if len(words) < SHORTEST:
                continue
            for mask, offsets in enumerate(_OFFSETS):
                keys = windows(words, offsets, mask)
                found.append(np.stack([keys, np.full(len(keys), item, np.uint64), np.arange(len(keys), dtype=np.uint64)]))
        table = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.uint64)
        order = np.argsort(table[0], kind="stable")
        self.keys, self.items, self.places = table[0][order], *table[1:, order].astype(np.int64)
        self.bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
        slots = (self.keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        np.bitwise_or.at(self.bitmap, slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (position in ``words`` of the item's first word, item)."""
        lines, items = [], []
        for mask, offsets in enumerate(_OFFSETS):
            keys = windows(words, offsets, mask)
            slots = (keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            at = np.flatnonzero((self.bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1)
            first = np.searchsorted(self.keys, keys[at], side="left")
            sizes = np.searchsorted(self.keys, keys[at], side="right") - first
            source = np.repeat(first - np.r_[0, np.cumsum(sizes)][:-1], sizes) + np.arange(sizes.sum())
            lines.append(np.repeat(at, sizes) - self.places[source])
            items.append(self.items[source])
        both = np.unique(np.stack([np.concatenate(lines), np.concatenate(items)]), axis=1)
        return both[0], both[1]


def overlap(words: np.ndarray, item: np.ndarray, line: int) -> tuple[int, int, int, int] | None:
    """doc_start, item_start, n_words, n_matched of the best stretch of an item laid at ``line``."""
    a, b = max(0, line), min(len(words), line + len(item))
    same = words[a:b] == item[a - line : b - line]
    wanted = MIN_MATCHED if len(item) >= MIN_MATCHED else SIMILARITY * len(item)
    if same.sum() < wanted:
        return None
    sums = np.r_[0, np.cumsum(np.where(same, 1, -PENALTY))]
    equal = np.r_[0, np.cumsum(same)]
    # A stretch is similar enough if its sum is not negative. To each end belongs the first start
    # whose sum is no larger: a longer stretch never holds fewer equal words.
    low = np.minimum.accumulate(sums)
    start = np.searchsorted(-low, -sums, side="left")
    matched = equal - equal[start]
    end = int(matched.argmax())  # of equal ones the first
    if not matched[end] or matched[end] < wanted:
        return None
    first = int(start[end]) + int(same[start[end] : end].argmax())
    return a + first, a - line + first, end - first, int(matched[end])


def leaks_of(texts: list[str], index: Index, hasher: Hasher) -> list[list[tuple]]:
    """Overlaps of each text: the best of each item, by item id and place."""
    hashes, counts = hasher(texts)
    firsts = np.r_[0, np.cumsum(counts)]
    out: list[dict] = [{} for _ in texts]
    lines, items = index.hits(hashes)
    if not len(lines):
        return [[] for _ in texts]
    # The line may begin before its document; a hit's own windows tell where it lies. Try all texts
    # that the item touches; windows across two texts find nothing when verified in one.
    lengths = np.array([len(w) for w in index.words])
    low = np.searchsorted(firsts, np.maximum(lines, 0), side="right") - 1
    high = np.searchsorted(firsts, np.minimum(lines + lengths[items], firsts[-1]) - 1, side="right") - 1
    for line, item, first, last in zip(lines.tolist(), items.tolist(), low.tolist(), high.tolist()):
        for text in range(first, last + 1):
            words = hashes[firsts[text] : firsts[text + 1]]
            if len(words) and (found := overlap(words, index.words[item], line - int(firsts[text]))):
                best = out[text].get(item)
                if best is None or (-found[3], found) < (-best[3], best):
                    out[text][item] = found
    order = lambda row: (row[0] is None, row[0] or 0, row[1:])
    return [sorted(((index.ids[i], *f) for i, f in found.items()), key=order) for found in out]


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if not given) with ``leaks``, overlaps with benchmark items.

    ``benchmark`` has item_id (long) and text.
    """
    keep = [c for c in (keep or docs.columns) if c != "leaks"]
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    sizes = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"))
    total = items.agg(F.sum(sizes)).collect()[0][0] or 0
    parts = max(1, -(-total * len(MASKS) // INDEX_WINDOWS))
    marked = docs.drop("leaks").withColumn("leaks", F.array().cast(_LEAKS))
    for part in range(parts):
        chunk = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        last = part == parts - 1
        marked = _mark(marked, [(r[0], r[1]) for r in chunk.collect()], keep if last else None)
    return marked


def _mark(docs: DataFrame, items: list[tuple], keep: list[str] | None) -> DataFrame:
    names = keep if keep is not None else [c for c in docs.columns if c != "leaks"]
    source = docs.select(*dict.fromkeys([*names, "text", "leaks"]))
    schema = T.StructType([*source.select(*names).schema, T.StructField("leaks", _LEAKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(ascii_words=False)
        index = Index(items, hasher)
        fields = ("item_id", "doc_start", "item_start", "n_words", "n_matched")
        for batch in tidy(batches):
            for part in slices(batch, BATCH_BYTES):
                place = part.schema.get_field_index
                found = leaks_of(texts_of(part), index, hasher)
                before = part.column(place("leaks"))
                if any(found):
                    old = before.to_pylist()
                    rows = [o + [dict(zip(fields, f)) for f in new] for o, new in zip(old, found)]
                    before = pa.array(rows, before.type)
                yield pa.RecordBatch.from_arrays([*(part.column(place(c)) for c in names), before], [*names, "leaks"])

    return source.mapInArrow(run, schema)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that overlap."""
    return mark(docs, benchmark, ["doc_id"]).select("doc_id", F.inline("leaks"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return mark(docs, benchmark).where(F.size("leaks") == 0).select(*docs.columns)
