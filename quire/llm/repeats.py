"""Long repeated passages, found by logarithmically many levels of anchors sorted by hash.

What is removed: every byte covered by a string of ``LENGTH`` bytes that also starts earlier,
in a document of smaller id or further left in the same one. Overlaps count.

Method. Suffixes are indexed at content-defined places only. Each window of ``LENGTH`` bytes has
an anchor, the leftmost of its ``GRAM``-byte grams of smallest hash; equal windows have it at
the same offset, so two equal windows meet at equal anchors. Windows in a row with one
anchor make an entry: the gram's hash, a hash of the context (all bytes of its windows),
place and number of windows. An array holds the entries of a batch of documents in order
of the gram's hash (not in suffix order), in shards by ranges of the gram's hash.

Batches come in order of doc_id. A new batch's array is merge-scanned against the levels that
exist: an entry whose context occurred earlier is removed whole; entries with the same gram
and different contexts are put aside with those that they met. Then the batch's first
entries become a level of their own, and levels of equal size merge, so that there are
logarithmically many. Last, the contexts put aside are fetched and compared window by window
at their shard, and what is not the first of its kind is removed. This is linear in the
contexts, however often one occurs; pairs are never listed.

Documents are packed into blocks once; blocks and levels are bucketed tables, which later
joins read in place. Of equal entries of a block only the first is sent; the others are
removed where the block is. The entries of one gram meet in one task, unless the gram is hot
(``HOT`` entries after that, counted in blocks where it has ``HOT_IN_BLOCK``). Those of hot
grams skip the arrays: the hash of each window goes to a shard of its own hash, with the first
place of each piece of a block, so that the work is dealt by window.

Edge cases. A null or empty text has no bytes and keeps none. Texts shorter than ``LENGTH`` are
kept whole. A null doc_id counts as smallest. Rows of equal id come in the order in
which they were packed. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bucketed, pack_columns, slices, texts_of, tidy, unpack_columns
from quire.llm.words import mixed, powers
from quire.session import materialize

LENGTH = 100
GRAM = 20
BATCHES = 4
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 19
SEGMENT = 2 << 20  # window starts of a long document that are handled at once
SHARD_BYTES = 8 << 20  # of text, for each shard
COMPARED = 1 << 19  # bytes of contexts compared at once
HOT = 4096
HOT_IN_BLOCK = 4
HOT_SHARD = 1 << 18  # windows for each shard
_LOW = np.uint64((1 << 24) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ENTRY = ("u8", "u8", "i8", "i8", "i8", "u1")  # gram, context, doc_id, block, place, windows
_WINDOW = ("u8", "i8", "i8")  # hash, doc_id, place
_PLACE = ("i8", "u4")  # document in its block and start (32 bits each), number of windows


class Anchors:
    """Entries of texts. Keeps the powers of the hash base."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return sums

    def entries(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """gram, context, start and number of windows of each entry; documents end at ``ends``."""
        n = len(data)
        if n < LENGTH:
            return tuple(np.zeros(0, k) for k in ("u8", "u8", "i8", "u1"))
        sums = self.sums(data)
        m = n - GRAM + 1
        grams = mixed((sums[GRAM:] - sums[:m]) * self.down[:m])
        wide = LENGTH - GRAM + 1
        keys = np.full(-(-m // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        keys[:m] = (grams & ~_LOW) | np.arange(m, dtype=np.uint64)
        grid = keys.reshape(-1, wide)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - LENGTH + 1
        anchor = (np.minimum(back[:count], ahead[wide - 1 : wide - 1 + count]) & _LOW).astype(np.int64)
        inside = np.ones(count, bool)  # windows that end in the document in which they start
        for end in ends.tolist():
            inside[max(0, end - LENGTH + 1) : end] = False
        places = np.flatnonzero(inside)
        if not len(places):
            return tuple(np.zeros(0, k) for k in ("u8", "u8", "i8", "u1"))
        anchor = anchor[places]
        fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (places[1:] != places[:-1] + 1)]
        first = np.flatnonzero(fresh)
        windows = np.diff(np.r_[first, len(places)])
        start = places[first]
        stop = start + windows + LENGTH - 1
        context = mixed((sums[stop] - sums[start]) * self.down[start] + windows.astype(np.uint64) * _ODD)
        # An anchor's hash is the smallest of many; mixed again, it spreads evenly over the shards.
        return mixed(grams[anchor[first]] + _ODD), context, start, windows.astype(np.uint8)


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """Rising with the gram's hash, so that the entries of one shard lie together."""
    return (((grams >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents packed by batch: block, doc_ids, lengths, n_bytes, compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        shrink = zstandard.ZstdCompressor(level=1)
        hold: dict[int, list] = {}
        size: dict[int, int] = {}
        number = TaskContext.get().partitionId() << 32

        def packed(group: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, texts = zip(*hold.pop(group))
            size.pop(group)
            row = {
                "batch": group,
                "block": number,
                "doc_ids": list(ids),
                "lengths": [len(t) for t in texts],
                "n_bytes": sum(map(len, texts)),
                "texts": shrink.compress(b"".join(texts)),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in tidy(batches):
            for part in slices(batch, SLICE_BYTES):
                ids, groups = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "batch"))
                for key, group, text in zip(ids, groups, texts_of(part)):
                    raw = text.encode()
                    if size.get(group, 0) and size[group] + len(raw) > BLOCK_BYTES:
                        yield packed(group)
                    hold.setdefault(group, []).append((key, raw))
                    size[group] = size.get(group, 0) + len(raw)
        for group in list(hold):
            yield packed(group)

    kinds = [("batch", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
    schema = pa.schema([*kinds, ("lengths", pa.list_(pa.int64())), ("n_bytes", pa.int64()), ("texts", pa.binary())])
    return docs.mapInArrow(
        run, "batch int, block long, doc_ids array<long>, lengths array<long>, n_bytes long, texts binary"
    )


def _data(row: dict) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(row["texts"], max(1, row["n_bytes"]))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _pieces(lengths: list[int]) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """Byte ranges of a block to be handled at once: start, stop, ends of its documents, first document.

    A long document comes in segments that overlap, so that no window is missed or seen twice.
    """
    at = first = 0
    while first < len(lengths):
        last, size = first, 0
        while last < len(lengths) and (last == first or size + lengths[last] <= SLICE_BYTES):
            size += lengths[last]
            last += 1
        if last == first + 1 and size > SEGMENT:
            for start in range(0, size - LENGTH + 1, SEGMENT):
                stop = min(size, start + SEGMENT + LENGTH - 1)
                yield at + start, at + stop, np.array([stop - start]), first
        else:
            yield at, at + size, np.cumsum(lengths[first:last]), first
        at += size
        first = last


def _entries(row: dict, data: np.ndarray, anchors: Anchors) -> tuple[np.ndarray, ...]:
    """A block's entries by gram: gram, context, doc_id, place, windows, first of its kind in the block."""
    starts = np.r_[0, np.cumsum(row["lengths"])]
    found = []
    for a, b, ends, _ in _pieces(row["lengths"]):
        gram, context, start, windows = anchors.entries(data[a:b], ends)
        found.append((gram, context, start + a, windows))
    gram, context, start, windows = (np.concatenate(c) for c in zip(*found))
    doc = np.searchsorted(starts, start, side="right") - 1
    least = np.iinfo(np.int64).min
    ids = np.array([least if i is None else i for i in row["doc_ids"]], np.int64)[doc]
    place = (doc << 32) | (start - starts[doc])
    order = np.lexsort((place, ids, context, gram))
    gram, context, ids, place, windows = (c[order] for c in (gram, context, ids, place, windows))
    first = np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])][: len(gram)]
    return gram, context, ids, place, windows, first


def _hot(blocks: DataFrame, in_block: int, least: int) -> tuple[np.ndarray, int]:
    """Grams of many entries, sorted, and the number of their entries; at most one for ``least`` entries of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in tidy(batches):
            for row in _rows(batch):
                gram, *_, first = _entries(row, np.frombuffer(_data(row), np.uint8), anchors)
                own, counts = np.unique(gram[first], return_counts=True)
                own, counts = own[counts >= in_block], counts[counts >= in_block]
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(counts)], ["gram", "n"])

    wanted = blocks.select("block", "doc_ids", "lengths", "n_bytes", "texts")
    counted = wanted.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= least).collect()
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(np.uint64)), sum(r["n"] for r in rows)


def _requests(blocks: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """shard, block and packed entries, sorted by gram; without those of hot grams and repeats in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in tidy(batches):
            for row in _rows(batch):
                *columns, first = _entries(row, np.frombuffer(_data(row), np.uint8), anchors)
                gram, context, ids, place, windows = (c[first & ~np.isin(columns[0], hot)] for c in columns)
                block = np.full(len(gram), row["block"], np.int64)
                cuts = np.flatnonzero(np.diff(shard_of(gram, shards))) + 1
                bounds = [0, *cuts.tolist(), len(gram)] if len(gram) else []
                sent = []
                for i, j in zip(bounds, bounds[1:]):
                    packed = pack_columns(*(c[i:j] for c in (gram, context, ids, block, place, windows)))
                    sent.append((int(shard_of(gram[i : i + 1], shards)[0]), row["block"], packed))
                if sent:
                    kinds = [pa.int32(), pa.int64(), pa.binary()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*sent), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "entries"])

    wanted = blocks.select("block", "doc_ids", "lengths", "n_bytes", "texts")
    return wanted.mapInArrow(run, "shard int, block long, entries binary")


def _hot_windows(blocks: DataFrame, hot: np.ndarray, shards: int) -> DataFrame:
    """Windows of hot grams: kind 0, the first of each piece of a block, by shard; kind 1, the others, as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in tidy(batches):
            for row in _rows(batch):
                data = np.frombuffer(_data(row), np.uint8)
                gram, _, ids, place, windows, first = _entries(row, data, anchors)
                own = np.flatnonzero(first & np.isin(gram, hot))
                ids, place, windows = ids[own], place[own], windows[own].astype(np.int64)
                at = np.r_[0, np.cumsum(row["lengths"])][place >> 32] + (place & 0xFFFFFFFF)
                total = np.cumsum(windows + LENGTH - 1)
                i = 0
                while i < len(own):
                    j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + COMPARED, side="right")))
                    yield _piece(row["block"], ids[i:j], place[i:j], windows[i:j], at[i:j], data, anchors)
                    i = j

    def _piece(block, ids, place, windows, at, data, anchors) -> pa.RecordBatch:
        size = windows + LENGTH - 1
        begin = np.r_[0, np.cumsum(size)][:-1]
        sums = anchors.sums(data[np.repeat(at - begin, size) + np.arange(size.sum())])
        step = np.arange(windows.sum()) - np.repeat(np.r_[0, np.cumsum(windows)][:-1], windows)
        start = np.repeat(begin, windows) + step
        hashes = mixed((sums[start + LENGTH] - sums[start]) * anchors.down[start])
        ids, place = np.repeat(ids, windows), np.repeat(place, windows) + step
        order = np.lexsort((place, ids, hashes))
        fresh = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
        rest, order = order[~fresh], order[fresh]
        columns = [c[order] for c in (hashes, ids, place)]
        shard = shard_of(columns[0], shards)
        bounds = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(order)]
        out = [(0, int(shard[i]), block, pack_columns(*(c[i:j] for c in columns))) for i, j in zip(bounds, bounds[1:])]
        gone = _runs_by_block(np.full(len(rest), block), place[rest])
        out += [(1, None, block, packed) for packed in gone.values()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["kind", "shard", "block", "entries"])

    wanted = blocks.select("block", "doc_ids", "lengths", "n_bytes", "texts")
    return wanted.mapInArrow(run, _SCANNED)


def _later_windows(windows: DataFrame) -> DataFrame:
    """Of equal windows of a shard all but the first, as runs by block."""

    def run(group: pa.Table) -> pa.Table:
        parts = [unpack_columns(d, *_WINDOW) for d in group.column("entries").to_pylist()]
        hashes, ids, place = (np.concatenate(c) for c in zip(*parts))
        block = np.repeat(group.column("block").to_numpy(), [len(p[0]) for p in parts])
        order = np.lexsort((place, block, ids, hashes))
        later = order[np.r_[False, hashes[order][1:] == hashes[order][:-1]]]
        found = _runs_by_block(block[later], place[later])
        return pa.table(
            [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["block", "entries"]
        )

    return windows.groupBy("shard").applyInArrow(run, "block long, entries binary")


def _runs_by_block(block: np.ndarray, place: np.ndarray) -> dict[int, bytes]:
    """Packed runs of windows that follow each other."""
    order = np.lexsort((place, block))
    block, place = block[order], place[order]
    begin = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (place[1:] != place[:-1] + 1)][: len(block)])
    runs = np.diff(np.r_[begin, len(block)])
    none = np.zeros(len(runs), np.int64)
    return _by_block([none, none, none, block[begin], place[begin], runs], np.arange(len(runs)), False)


def merge_scan(new: list[bytes], levels: list[bytes]) -> tuple[bytes, dict[int, bytes], dict[int, bytes]]:
    """A batch's entries of one shard against the levels.

    Gives the entries that are first of their context, as the batch's level; then by block
    what is removed whole, and what must be compared by context.
    """
    parts = [unpack_columns(d, *_ENTRY) for d in (*levels, *new)]
    columns = [np.concatenate(c) for c in zip(*parts)]
    fresh = np.repeat([False] * len(levels) + [True] * len(new), [len(p[0]) for p in parts])
    order = np.argsort(columns[0], kind="stable")  # merges arrays that are sorted already
    columns, fresh = [c[order] for c in columns], fresh[order]
    gram = columns[0]
    edge = np.r_[True, gram[1:] != gram[:-1]]
    group = np.cumsum(edge) - 1
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    gram, context, doc, block, place, windows = (c[many] for c in columns)
    order = np.lexsort((place, block, doc, context, gram))
    many = many[order]
    gram, context = gram[order], context[order]
    alike = np.r_[False, (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])][: len(gram)]
    gone = many[alike & fresh[many]]
    firsts = many[~alike]
    own = group[firsts]
    contexts = np.bincount(own, minlength=group[-1] + 1 if len(group) else 0)
    news = np.bincount(own, fresh[firsts], minlength=len(contexts))
    open_ = firsts[(contexts[own] > 1) & (news[own] > 0)]
    keep = fresh.copy()
    keep[gone] = False
    level = pack_columns(*(c[keep] for c in columns))
    return level, _by_block(columns, gone, False), _by_block(columns, open_, True)


def _by_block(columns: list[np.ndarray], which: np.ndarray, whole: bool) -> dict[int, bytes]:
    which = which[np.argsort(columns[3][which], kind="stable")]
    block = columns[3][which]
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else []
    out = {}
    for i, j in zip(cuts, cuts[1:]):
        some = [c[which[i:j]] for c in columns]
        out[int(block[i])] = pack_columns(*some) if whole else pack_columns(some[4], some[5].astype(np.uint32))
    return out


class Family:
    """Levels of suffix arrays. Each is one row a shard, bucketed by shard."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []  # number of batches, entries

    def add(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Scan a batch against all levels and make it one; what is removed whole, what is open."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, _merged(a, b)))
        wide = requests.groupBy("shard").agg(F.collect_list("entries").alias("new"))
        names = []
        for i, (_, level) in enumerate(self.levels):
            names.append(f"level{i}")
            wide = wide.join(level.select("shard", F.col("entries").alias(names[-1])), "shard", "left")
        joined = wide.select("shard", "new", F.array_compact(F.array(*names)) if names else F.array().cast("array<binary>"))
        out = bucketed(joined.toDF("shard", "new", "levels").mapInArrow(_scan, _SCANNED), "suffix-level", "shard", ["kind"])
        self.levels.append((1, out.where("kind = 0").select("shard", "entries")))
        return tuple(out.where(F.col("kind") == kind).select("block", "entries") for kind in (1, 2))


_SCANNED = "kind int, shard int, block long, entries binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tidy(batches):
        for row in _rows(batch):
            level, gone, open_ = merge_scan(row["new"], row["levels"])
            found = [(0, row["shard"], None, level)]
            found += [(1, row["shard"], block, data) for block, data in gone.items()]
            found += [(2, row["shard"], block, data) for block, data in open_.items()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "shard", "block", "entries"])


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for row in _rows(batch):
                parts = [unpack_columns(row[c], *_ENTRY) for c in ("a", "b") if row[c] is not None]
                columns = [np.concatenate(c) for c in zip(*parts)]
                order = np.argsort(columns[0], kind="stable")
                packed = pack_columns(*(c[order] for c in columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]], pa.int32()), pa.array([packed], pa.binary())], ["shard", "entries"]
                )

    both = a.withColumnRenamed("entries", "a").join(b.withColumnRenamed("entries", "b"), "shard", "full")
    return bucketed(both.mapInArrow(run, "shard int, entries binary"), "suffix-level", "shard")


def _contexts(blocks: DataFrame, open_: DataFrame, shards: int) -> DataFrame:
    """Entries put aside with the bytes of their windows: shard, block, entries, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shrink = zstandard.ZstdCompressor(level=1)
        for batch in tidy(batches):
            for row in _rows(batch):
                data = np.frombuffer(_data(row), np.uint8)
                starts = np.r_[0, np.cumsum(row["lengths"])]
                columns = [np.concatenate(c) for c in zip(*(unpack_columns(d, *_ENTRY) for d in row["asked"]))]
                _, once = np.unique(columns[4], return_index=True)  # batches may ask for one entry each
                columns = [c[once] for c in columns]
                order = np.argsort(columns[0], kind="stable")
                columns = [c[order] for c in columns]
                at = starts[columns[4] >> 32] + (columns[4] & 0xFFFFFFFF)
                size = columns[5].astype(np.int64) + LENGTH - 1
                cuts = np.flatnonzero(np.diff(shard_of(columns[0], shards))) + 1
                bounds = [0, *cuts.tolist(), len(at)]
                sent = []
                for i, j in zip(bounds, bounds[1:]):
                    source = np.repeat(at[i:j] - np.r_[0, np.cumsum(size[i:j])][:-1], size[i:j])
                    source += np.arange(len(source))
                    shard = int(shard_of(columns[0][i : i + 1], shards)[0])
                    sent.append((shard, row["block"], pack_columns(*(c[i:j] for c in columns)), shrink.compress(data[source].tobytes())))
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*sent), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "entries", "bytes"])

    asked = open_.groupBy("block").agg(F.collect_list("entries").alias("asked"))
    wanted = blocks.select("block", "lengths", "n_bytes", "texts").join(asked, "block")
    return wanted.mapInArrow(run, "shard int, block long, entries binary, bytes binary")


def compare(columns: list[np.ndarray], data: np.ndarray, anchors: Anchors) -> dict[int, bytes]:
    """Windows of entries of one shard that are not the first of their kind, as runs by block.

    Grams are taken a few at a time; only a single gram with more contexts takes more memory.
    """
    size = columns[5].astype(np.int64) + LENGTH - 1
    at = np.r_[0, np.cumsum(size)][:-1]
    order = np.lexsort((columns[4], columns[3], columns[2], columns[0]))
    gram = columns[0][order]
    ends = np.r_[np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram)]  # of each gram's entries
    total = np.cumsum(size[order])
    found, first = [], 0
    while first < len(order):
        before = total[first - 1] if first else 0
        last = int(np.searchsorted(total, before + COMPARED, side="right"))
        fits = ends[ends <= last]
        stop = int(fits[-1]) if len(fits) and fits[-1] > first else int(ends[np.searchsorted(ends, first, side="right")])
        some = order[first:stop]
        found.append(_compared([c[some] for c in columns], at[some], size[some], data, anchors))
        first = stop
    block, place, runs = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    none = np.zeros(len(runs), np.int64)
    return _by_block([none, none, none, block, place, runs], np.arange(len(runs)), False)


def _compared(
    columns: list[np.ndarray], at: np.ndarray, size: np.ndarray, data: np.ndarray, anchors: Anchors
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, place and number of windows of each run; all entries of the grams that occur are given."""
    source = np.repeat(at - np.r_[0, np.cumsum(size)][:-1], size) + np.arange(size.sum())
    sums = anchors.sums(data[source])
    order = np.lexsort((columns[4], columns[3], columns[2]))
    windows = columns[5][order].astype(np.int64)
    step = np.arange(windows.sum()) - np.repeat(np.r_[0, np.cumsum(windows)][:-1], windows)
    start = np.repeat(np.r_[0, np.cumsum(size)][:-1][order], windows) + step
    hashes = mixed((sums[start + LENGTH] - sums[start]) * anchors.down[start])
    _, first = np.unique(hashes, return_index=True)
    gone = np.ones(len(hashes), bool)
    gone[first] = False
    entry = np.repeat(order, windows)
    which = np.flatnonzero(gone)
    fresh = np.r_[True, (which[1:] != which[:-1] + 1) | (entry[which[1:]] != entry[which[:-1]])][: len(which)]
    begin = np.flatnonzero(fresh)
    runs = np.diff(np.r_[begin, len(which)])
    own = entry[which[begin]]
    return columns[3][own], columns[4][own] + step[which[begin]], runs


def _resolved(contexts: DataFrame) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        import zstandard

        group = group.combine_chunks()
        parts = [unpack_columns(d, *_ENTRY) for d in group.column("entries").to_pylist()]
        columns = [np.concatenate(c) for c in zip(*parts)]
        unzip = zstandard.ZstdDecompressor()
        data = b"".join(unzip.decompress(d) for d in group.column("bytes").to_pylist())
        found = compare(columns, np.frombuffer(data, np.uint8), Anchors())
        return pa.table(
            [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["block", "entries"]
        )

    return contexts.groupBy("shard").applyInArrow(run, "block long, entries binary")


def _applied(blocks: DataFrame, gone: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in tidy(batches):
            for row in _rows(batch):
                yield from _documents(row, anchors)

    def _documents(row: dict, anchors: Anchors) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(_data(row), np.uint8)
        starts = np.r_[0, np.cumsum(row["lengths"])]
        covered = np.zeros(len(data) + 1, np.int32)
        *_, place, windows, first = _entries(row, data, anchors)
        repeated = (place[~first], windows[~first].astype(np.int64))
        for place, windows in (repeated, *(unpack_columns(packed, *_PLACE) for packed in row["gone"] or [])):
            at = starts[place >> 32] + (place & 0xFFFFFFFF)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + windows + LENGTH - 1, -1)
        # A removed range ends with its document, so none reaches into the next.
        removed = np.cumsum(covered[:-1]) > 0
        out, size = [], 0
        for doc, (a, b) in enumerate(zip(starts, starts[1:])):
            mask = removed[a:b]
            edges = np.flatnonzero(np.diff(mask, prepend=False, append=False))
            spans = [{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
            own = data[a:b][~mask] if spans else data[a:b]
            out.append((row["doc_ids"][doc], int(b - a), spans, own.tobytes()))
            size += len(own)
            if size > SLICE_BYTES:
                yield _packed(out)
                out, size = [], 0
        if out:
            yield _packed(out)

    def _packed(rows: list[tuple]) -> pa.RecordBatch:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), span, pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    lists_ = gone.groupBy("block").agg(F.collect_list("entries").alias("gone"))
    joined = blocks.select("block", "doc_ids", "lengths", "n_bytes", "texts").join(lists_, "block", "left")
    return joined.mapInArrow(
        run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes: start, end), kept (the other bytes) of each document."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    shares = [i / batches for i in range(1, batches)]
    known = rows.where(F.col("doc_id").isNotNull())
    bounds = known.approxQuantile("doc_id", shares, 0.01) if shares else []
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + F.coalesce(F.col("doc_id") > int(bound), F.lit(False)).cast("int")
    blocks = bucketed(_blocks(rows.withColumn("batch", batch)), "repeat-blocks", "block", ["batch"])
    size = blocks.agg(F.sum("n_bytes")).collect()[0][0] or 0
    shards = max(8, -(-size // SHARD_BYTES))
    hot, n_hot = _hot(blocks, HOT_IN_BLOCK, HOT)
    family, gone, open_ = Family(), [], []
    for i in range(len(bounds) + 1):
        whole, aside = family.add(_requests(blocks.where(F.col("batch") == i), int(shards), hot))
        gone.append(whole)
        open_.append(aside)
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    resolved = materialize(_resolved(_contexts(blocks, union(open_), int(shards))), "repeat-windows")
    if len(hot):
        hot_shards = max(8, -(-n_hot * (LENGTH - GRAM + 1) // HOT_SHARD))
        windows = materialize(_hot_windows(blocks, hot, hot_shards), "hot-windows")
        gone.append(windows.where("kind = 1").select("block", "entries"))
        gone.append(materialize(_later_windows(windows.where("kind = 0")), "later-windows"))
    return _applied(blocks, union([*gone, resolved]))
