"""Near-duplicate documents by min-max hashing, confirmed on full sets.

Method. A document is the set of its word shingles. Under each of ``bands * rows / 2`` permutations
both the smallest and the largest hash of the set are kept; either agrees between two sets
with a probability of their similarity, and together they halve the hash evaluations and
estimate it with lower variance than two independent minima. ``rows`` values in a row form
a band; documents that agree on a band are candidates.

Documents with equal sets are one class, represented by its smallest id, before anything is
compared. Documents of a block that agree on a band are tied to the first of them where they are, so of each key a
block sends one row, however many documents share it. Candidates that hang together form a cluster. The
sets of members are made where their texts are read: a filter of bounded size (Bloom's; ``FILTER_BITS``
bits at most, some 1 % of other documents pass while it has ten for each member) leaves out most others, and
the exact join that follows the rest, so no text is shuffled. Within a cluster similarity is
counted exactly on the full sets, block against block, as sums of 0/1 matrix products; pairs
are never listed, only what links each block together. A large cluster is first compared
with its most central member; what links to it need not be compared with each other, and
the rest meets all others in blocks of bounded size, spread over tasks. No link between
members of a cluster is lost; two similar documents miss each other only if no band agrees
(probability ``(1 - s ** rows) ** bands`` for similarity s).

Edge cases. Null and empty texts have an empty set and link with nothing. With fewer words than a
shingle the whole sequence is the shingle. A null doc_id links with nothing and has no
component. Rows of equal
id are one document, of which the largest set counts; each row gets its component. An empty table gives an empty result. Extra
columns are ignored by ``near_duplicates`` and kept by ``drop_duplicates_of``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import lists, slices, texts_of, tidy
from quire.llm.graph import components
from quire.llm.words import Hasher, mixed, windows
from quire.session import discard, materialize

BATCH_BYTES = 1 << 20
BLOCK_DOCS = 512
BLOCK_SHINGLES = 1 << 19
TIED_KEYS = 1 << 18  # band keys of a block
SALTS = 32  # parts of a large cluster that meet its central member
FILTER_BITS = 1 << 28
FILTER_HASHES = 5
_PAGE_BITS = 1 << 15  # of one of Spark's bitmaps
_SET = ["n_shingles", "h1", "h2"]
_OWN = ["rep", *_SET]
_COLUMNS = 4096  # of a matrix at a time


def shingle_sets(texts: list[str], words: int, hasher: Hasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, counts = hasher(texts)
    shingles = windows(hashes, tuple(range(words)), words)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(shingles[at : at + n - words + 1]))
        elif n:
            out.append(windows(hashes[at : at + n], tuple(range(n)), n))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two hashes of each set; equal for equal sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    both = np.zeros((2, len(sets)), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate(sets)
        firsts = np.r_[0, np.cumsum(sizes[full])][:-1]
        both[0, full] = np.bitwise_xor.reduceat(mixed(flat + np.uint64(1)), firsts)
        both[1, full] = np.add.reduceat(mixed(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), firsts)
    return sizes, both[0].astype(np.int64), both[1].astype(np.int64)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    factors = rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1)
    return factors, rng.integers(0, 1 << 32, count, np.uint32)


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One key a band for each set; sets must not be empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    firsts = np.r_[0, np.cumsum(sizes)][:-1]
    values = (mixed(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    factors, shifts = permutations(bands * rows // 2)
    keys = np.zeros((len(sets), bands), np.uint64)
    for k, (factor, shift) in enumerate(zip(factors, shifts)):
        moved = values * factor + shift
        for j, ends in ((2 * k, np.minimum.reduceat(moved, firsts)), (2 * k + 1, np.maximum.reduceat(moved, firsts))):
            band = j // rows
            keys[:, band] = (keys[:, band] + ends) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
            keys[:, band] ^= keys[:, band] >> np.uint64(29)
    return mixed(keys + np.arange(bands, dtype=np.uint64))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, and band keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(ascii_words=True)
        for batch in tidy(batches):
            for part in slices(batch, BATCH_BYTES):
                sets = shingle_sets(texts_of(part), words, hasher)
                sizes, h1, h2 = set_hashes(sets)
                full = [s for s in sets if len(s)]
                keys = band_keys(full, bands, rows) if full else np.zeros((0, bands), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("doc_id")),
                        pa.array(sizes),
                        pa.array(h1),
                        pa.array(h2),
                        lists(keys.astype(np.int64).ravel(), np.where(sizes > 0, bands, 0)),
                    ],
                    ["doc_id", *_SET, "keys"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"
    )


def _filter_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The places of each id in a filter of so many bits, a row a hash."""
    values = ids.astype(np.int64).view(np.uint64)
    shifts = [np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for k in range(1, FILTER_HASHES + 1)]
    rows = [mixed(values + shift) % np.uint64(bits) for shift in shifts]
    return np.stack(rows).astype(np.int64)


def id_filter(ids: DataFrame, column: str) -> tuple[int, bytes]:
    """Bits of a Bloom filter of the ids, and how many they are: ten an id, ``FILTER_BITS`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = _filter_places(np.asarray(batch.column(0)), bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(places))], ["place"])

    bits = _PAGE_BITS
    wanted = 10 * ids.count()
    while bits < min(wanted, FILTER_BITS):
        bits *= 2
    places = ids.select(column).mapInArrow(run, "place long")
    pages = places.groupBy(F.expr(f"place div {_PAGE_BITS}").alias("page")).agg(
        F.bitmap_construct_agg(F.expr(f"place % {_PAGE_BITS}")).alias("bitmap")
    )
    whole = bytearray(bits // 8)
    for row in pages.collect():  # as many pages of 4 KB as the filter has, its size bounds them
        at = row["page"] * (_PAGE_BITS // 8)
        whole[at : at + len(row["bitmap"])] = row["bitmap"]
    return bits, bytes(whole)


def may_hold(ids: np.ndarray, bits: int, data: bytes) -> np.ndarray:
    """Whether the filter may hold each id; true for all that it was made of."""
    flags = np.frombuffer(data, np.uint8)
    places = _filter_places(ids, bits)
    return ((flags[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep, size and hashes of its set, and the set, of the wanted documents and a few others.

    Rows of one id may differ: size and hashes tell which one stands for it.
    """
    bits, data = id_filter(wanted, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(ascii_words=True)
        for batch in tidy(batches):
            batch = batch.filter(pa.compute.is_valid(batch.column(0)))
            batch = batch.filter(pa.array(may_hold(np.asarray(batch.column(0)), bits, data), pa.bool_()))
            for part in slices(batch, BATCH_BYTES):
                sets = shingle_sets(texts_of(part), words, hasher)
                sizes, h1, h2 = set_hashes(sets)
                flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
                columns = [part.column(0), *(pa.array(c) for c in (sizes, h1, h2)), lists(flat, sizes)]
                yield pa.RecordBatch.from_arrays(columns, ["rep", *_SET, "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("rep"), "text").mapInArrow(
        run, "rep long, n_shingles long, h1 long, h2 long, shingles array<long>"
    )


def _tied(first: DataFrame) -> DataFrame:
    """key, rep, first: per block of rows, the first document of each key (rep null), and what ties the
    others of a key to it (key null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            reps = np.asarray(batch.column("rep"))
            counts = np.asarray(pa.compute.list_value_length(batch.column("keys"))).astype(np.int64)
            held.append((np.repeat(reps, counts), np.asarray(batch.column("keys").flatten())))
            rows += int(counts.sum())
            if rows >= TIED_KEYS:
                yield _ties(held)
                held, rows = [], 0
        if held:
            yield _ties(held)

    def _ties(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        reps, keys = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((reps, keys))
        reps, keys = reps[order], keys[order]
        opens = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        at = np.flatnonzero(opens)
        least = reps[at][np.cumsum(opens) - 1]
        others = np.unique(np.stack([reps, least])[:, reps != least], axis=1)
        none = lambda n: pa.nulls(n, pa.int64())
        columns = [
            pa.concat_arrays([pa.array(keys[at]), none(others.shape[1])]),
            pa.concat_arrays([none(len(at)), pa.array(others[0])]),
            pa.concat_arrays([pa.array(reps[at]), pa.array(others[1])]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "rep", "first"])

    return first.select("rep", "keys").mapInArrow(run, "key long, rep long, first long")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every two sets."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    place = np.cumsum(times > 1) - 1
    column = place[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        grid = np.zeros((len(sets), _COLUMNS), np.float32)
        grid[owner[a:b], column[a:b] - first] = 1
        total += grid @ grid.T
    np.fill_diagonal(total, sizes)
    return total.astype(np.int64)


def forest(reps: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that join what is linked, a tree a component. Two members of one side are compared
    only if the side is 0 and no other side is present."""
    common = common_counts(sets)
    sizes = np.diag(common)
    union = sizes[:, None] + sizes[None, :] - common
    linked = 100 * common >= percent * union
    if (sides != sides[0]).any():
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, True)
    open_, edges = np.ones(len(reps), bool), []
    for start in np.argsort(reps).tolist():
        if not open_[start]:
            continue
        open_[start] = False
        front = np.array([start])
        while len(front):
            reached = np.flatnonzero(linked[front].any(axis=0) & open_)
            open_[reached] = False
            edges += [(int(r), int(reps[start])) for r in reps[reached]]
            front = reached
    return edges


def _verified(members: DataFrame, percent: int) -> DataFrame:
    """a, b: links within each unit. ``members`` has unit, side, rep, shingles."""

    def links(unit: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        reps = np.array([u[0] for u in unit])
        return forest(reps, [u[2] for u in unit], np.array([u[1] for u in unit]), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, unit = None, []
        for batch in tidy(batches):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            units, sides, reps, sets = (column(n) for n in ("unit", "side", "rep", "shingles"))
            edges = []
            for i, name in enumerate(units.to_pylist()):
                if name != current:
                    edges += links(unit) if len(unit) > 1 else []
                    current, unit = name, []
                unit.append((reps[i].as_py(), sides[i].as_py(), np.array(sets[i].values)))
            yield _edge_batch(edges)
        yield _edge_batch(links(unit) if len(unit) > 1 else [])

    def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        flat = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])

    spread = members.repartition("unit").sortWithinPartitions("unit", "rep")
    return spread.mapInArrow(run, "a long, b long")


def _with_sets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members with their sets, by the same plan at every size; of an id's rows the one whose set it is."""
    named = sets.select("rep", *[F.col(c).alias(f"set_{c}") for c in _SET], "shingles").hint("merge")
    met = members.join(named, "rep")
    for c in _SET:
        # Written so that it is no key of the join, which would then deal the sets anew.
        met = met.where((F.col(c) <= F.col(f"set_{c}")) & (F.col(c) >= F.col(f"set_{c}"))).drop(f"set_{c}")
    return met


def _units(clustered: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members by unit of comparison, and how those of large clusters stand to their central member."""
    sizes = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("n_shingles").alias("shingles_in"),
        F.max_by("rep", F.struct("central", -F.col("rep"))).alias("pivot"),
    )
    small = (F.col("docs") <= BLOCK_DOCS) & (F.col("shingles_in") <= BLOCK_SHINGLES)
    placed = clustered.join(sizes, "cluster")
    name = lambda *parts: F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    few = placed.where(small).select(*_OWN, F.lit(0).alias("side"), F.col("cluster").cast("string").alias("unit"))

    many = placed.where(~small)
    centre = _with_sets(many.where(F.col("rep") == F.col("pivot")), sets).withColumnRenamed("shingles", "core")
    # A large cluster meets its central member in several tasks.
    centre = centre.select("pivot", "core", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = many.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    met = _with_sets(salted, sets).join(centre, ["pivot", "salt"])
    common = F.size(F.array_intersect("shingles", "core"))
    union = F.size("shingles") + F.size("core") - common
    met = met.select(*_OWN, "cluster", "pivot", (100 * common >= percent * union).alias("linked"))
    met = materialize(met, "cluster-stars")
    compared = met
    half_docs, half_shingles = BLOCK_DOCS // 2, BLOCK_SHINGLES // 2
    blocks = lambda flag: F.greatest(
        F.ceil(F.count(F.when(F.col("linked") == flag, 1)) / half_docs),
        F.ceil(F.coalesce(F.sum(F.when(F.col("linked") == flag, F.col("n_shingles"))), F.lit(0)) / half_shingles),
    ).cast("int")
    counts = met.groupBy("cluster").agg(blocks(False).alias("open_blocks"), blocks(True).alias("done_blocks"))
    met = met.join(counts, "cluster").where("open_blocks > 0")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("linked"), F.col("done_blocks")).otherwise(F.col("open_blocks")))
    met = met.withColumn("own", own.cast("int"))
    upto = lambda column: F.sequence(F.lit(0), F.col(column) - 1)
    done = met.where("linked").select("*", F.explode(upto("open_blocks")).alias("other"))
    done = done.select(*_OWN, F.lit(1).alias("side"), name("cluster", F.lit("d"), "other", "own").alias("unit"))
    open_ = met.where("not linked")
    with_done = open_.where("done_blocks > 0").select("*", F.explode(upto("done_blocks")).alias("other"))
    with_done = with_done.select(*_OWN, F.lit(0).alias("side"), name("cluster", F.lit("d"), "own", "other").alias("unit"))
    with_open = open_.select("*", F.explode(upto("open_blocks")).alias("other"))
    with_open = with_open.select(
        *_OWN,
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
        name("cluster", F.lit("o"), F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
    )
    return few.unionByName(done).unionByName(with_done).unionByName(with_open), compared


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 36, rows: int = 7) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept."""
    signed = materialize(signatures(docs, words, bands, rows), "signatures")
    known = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # Rows of one id are one document; its largest set stands for it.
    largest = known.groupBy("doc_id").agg(F.max(F.struct(*_SET)).alias("s"))
    known = largest.select("doc_id", "s.*")
    classes = known.groupBy(*_SET).agg(F.min("doc_id").alias("rep"))
    # Equal sets have equal keys, and both sides are dealt by the set.
    full = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    keys = full.groupBy(*_SET).agg(F.first("keys").alias("keys"))
    alike = materialize(classes.join(keys, _SET), "classes")
    classes = alike.drop("keys")
    # One exchange: a key has a row a block there, and its rows look at each other where they are.
    tied = _tied(alike).withColumns({"at": F.coalesce("key", "rep"), "local": F.col("key").isNull()})
    least = F.min("first").over(Window.partitionBy("at", "local"))
    ties = tied.select(
        F.when(F.col("local"), F.col("rep")).otherwise(F.col("first")).alias("a"),
        F.when(F.col("local"), F.col("first")).otherwise(least).alias("b"),
    ).where("a <> b")
    near = materialize(ties.groupBy("a", "b").agg(F.count(F.lit(1)).alias("bands")), "candidates")
    clusters = components(near)
    ends = near.select(F.explode(F.array("a", "b")).alias("rep"), "bands")
    central = ends.groupBy("rep").agg(F.sum("bands").alias("central"))
    clustered = central.join(clusters.select(F.col("id").alias("rep"), F.col("component").alias("cluster")), "rep")
    clustered = materialize(clustered.join(classes, "rep"), "clusters")
    discard(near)
    discard(clusters)
    # Equal rows repeat here; they link with themselves, which changes nothing.
    # Dealt by document once; what meets them there moves to them.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = _full_sets(docs, clustered, words).repartition(tasks, "rep")
    sets = materialize(made, "full-sets", by=["rep"])
    units, compared = _units(clustered, sets, percent)
    stars = compared.where(F.col("linked") & (F.col("rep") != F.col("pivot")))
    stars = stars.select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    found = components(_verified(_with_sets(units, sets), percent).unionByName(stars))
    for table in (clustered, sets, compared):
        discard(table)
    by_doc = known.select("doc_id", *_SET).join(classes, _SET)
    by_doc = by_doc.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    by_doc = by_doc.select("doc_id", F.coalesce("component", "rep").alias("component"))
    joined = signed.select("doc_id", "n_shingles").join(by_doc, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_duplicates_of(docs: DataFrame, **parameters) -> DataFrame:
    """The document of smallest id of each component."""
    gone = near_duplicates(docs, **parameters).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
