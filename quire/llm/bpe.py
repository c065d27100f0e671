"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Method. The texts of a batch become one array of code points. A table gives each its
class (letter, number, space, other white space, other), and one or two code points
of lookahead refine it: an apostrophe that may open a contraction, the letter
that would close it, a white-space character that ends its run. What such a symbol does to the scanner (in letters, in
a pending space, ...) is a function from states to states. These functions are closed
under composition and few, so each has a small number and composing two is a lookup
in a table. Composition is associative: the state before every character comes from
a prefix scan over blocks, all blocks at once, without a regular expression. A text's
first character resets the state, so texts of a batch share one scan.

The slices between boundaries go through a cache of merged pieces, looked up by hash for
a batch at once; those missing are merged pair by pair in rank order, many side by side. Each id keeps the byte offset where it ends, from
which decoding copies vocabulary bytes into place and any range can be decoded alone.

Edge cases. A null or empty text has no ids and decodes to no bytes. Long texts are
handled whole. Repeated rows stay. Other columns pass through; columns named ``ids``,
``ends`` or ``decoded`` are replaced by the operator's.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import lists, slices, texts_of, tidy

# Classes of code points.
OTHER, LETTER, NUMBER, SPACE, WHITE = range(5)
# Symbols of the scanner: classes refined by lookahead. RESET marks a text's start.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE, S_CLOSING, S_WHITE, S_LAST_SPACE, S_LAST_WHITE = range(8)
RESET = 8
# States: nothing open, in a run, a space that joins what follows, inside a contraction.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, PENDING, CONTRACTED = range(7)

BATCH_BYTES = 1 << 20
SEGMENT_CHARS = 1 << 20
CACHE_BITS = 19  # slots of the cache of pieces
POOL_IDS = 1 << 23
LONGEST_CACHED = 64
WIDEST = 64  # bytes of a piece that is merged among others
NEVER = 1 << 40
HASH_BASE = 0x5851F42D4C957F2D
_BLOCK = 128


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this character."""
    if state == CONTRACTED and symbol in (S_LETTER, S_CLOSING):
        return FREE if symbol == S_CLOSING else CONTRACTED, False
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    if symbol == S_LAST_SPACE:
        return PENDING, True
    if symbol == S_LAST_WHITE:
        return FREE, True
    joined = state == PENDING
    if symbol in (S_LETTER, S_CLOSING):
        return IN_LETTERS, not (joined or state == IN_LETTERS)
    if symbol == S_NUMBER:
        return IN_NUMBERS, not (joined or state == IN_NUMBERS)
    if joined or state == IN_OTHERS:
        return IN_OTHERS, False
    return CONTRACTED if symbol == S_QUOTE else IN_OTHERS, True


def _scanner() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each symbol's function, composition table, application table, start flags."""
    states = range(7)
    functions = [tuple(states)]  # number 0: nothing changes; fills up the last block
    number = {functions[0]: 0}

    def numbered(f: tuple) -> int:
        if f not in number:
            number[f] = len(functions)
            functions.append(f)
        return number[f]

    codes = []
    for symbol in range(2 * RESET):
        codes.append(
            numbered(
                tuple(_step(FREE if symbol >= RESET else s, symbol % RESET)[0] for s in states)
            )
        )
    table: dict[tuple[int, int], int] = {}
    done = 0
    while done < len(functions):  # close under composition
        done = len(functions)
        for a in range(done):
            for b in range(done):
                if (a, b) not in table:
                    f, g = functions[a], functions[b]
                    table[a, b] = numbered(tuple(g[f[s]] for s in states))
    size = len(functions)
    compose = np.zeros((256, 256), np.uint8)
    for (a, b), c in table.items():
        compose[a, b] = c
    apply = np.zeros((256, 8), np.uint8)
    apply[:size, :7] = functions
    starts = np.array([[_step(s, x)[1] for x in range(RESET)] for s in states], bool)
    return np.array(codes, np.uint8), compose.ravel(), apply.ravel(), starts.ravel()


_CODES, _COMPOSE, _APPLY, _STARTS = _scanner()


def _prefix_states(codes: np.ndarray) -> np.ndarray:
    """State after each position, from FREE: scan inside blocks, then over the blocks."""
    n = len(codes)
    rows = -(-n // _BLOCK)
    grid = np.zeros(rows * _BLOCK, np.uint8)
    grid[:n] = codes
    grid = np.ascontiguousarray(grid.reshape(rows, _BLOCK).T)
    for j in range(1, _BLOCK):
        np.take(_COMPOSE, (grid[j - 1].astype(np.uint16) << 8) | grid[j], out=grid[j])
    before = np.zeros(rows, np.uint8)  # FREE
    if rows > 1:
        before[1:] = _prefix_states(grid[-1, :-1])
    states = np.take(_APPLY, (grid.astype(np.uint16) << 3) | before)
    return np.ascontiguousarray(states.T).ravel()[:n]


def class_table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Class of every code point from runs of equal class."""
    return np.repeat(runs[0], runs[1])


def class_runs(letters: set, numbers: set, white: set) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal class, a few thousand; small enough to go with each task."""
    table = np.zeros(0x110000, np.uint8)
    for members, kind in ((letters, LETTER), (numbers, NUMBER), (white, WHITE)):
        table[np.fromiter(members, np.int64, len(members))] = kind
    table[0x20] = SPACE
    first = np.flatnonzero(np.r_[True, table[1:] != table[:-1]])
    return table[first], np.diff(np.r_[first, len(table)])


def every_character() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


@lru_cache(maxsize=1)
def tiktoken_classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes as the tiktoken library sees them: it returns the bytes that a pattern matches."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}

    def members(pattern: str) -> set:
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        return {ord(c) for c in bytes(probe.encode_ordinary(every_character())).decode()}

    return class_runs(members(r"\p{L}"), members(r"\p{N}"), members(r"\s"))


_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")  # a piece always starts at such a space


def segments(texts: list[str], limit: int = SEGMENT_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts cut where a piece starts anyway, and the segments before each text.

    Bounds the arrays of a very long text. One without any such place stays whole.
    """
    out: list[str] = []
    firsts = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > limit and (cut := _CUT.search(text, at + limit)):
            out.append(text[at : cut.start()])
            at = cut.start()
        out.append(text[at:] if at else text)
        firsts[i + 1] = len(out)
    return out, firsts


def pre_tokenise(texts: list[str], table: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, their code points, the start of each piece, the pieces before each text.

    The last entry of the last two is the total.
    """
    joined = "".join(texts)
    n = len(joined)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.r_[0, np.cumsum(lengths)]
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    if not n:
        return joined, points, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    kinds = table[points]
    opens = np.zeros(n + 1, bool)  # the first character of a text, and the end of all
    opens[firsts] = True
    white = kinds >= SPACE
    follows = np.zeros(n, bool)  # another white-space character, or the text's end, follows
    follows[:-1] = white[1:]
    follows |= opens[1:]
    symbols = np.array([S_OTHER, S_LETTER, S_NUMBER, S_LAST_SPACE, S_LAST_WHITE], np.uint8)[kinds]
    symbols[white & follows] = S_WHITE
    quotes = np.flatnonzero(points == ord("'"))
    quotes = quotes[~opens[quotes + 1]]
    if len(quotes):
        one = points[quotes + 1]
        two = np.where(
            (quotes + 2 < n) & ~opens[np.minimum(quotes + 2, n)],
            points[np.minimum(quotes + 2, n - 1)],
            0,
        )
        short = np.isin(one, [ord(c) for c in "stmd"])
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
        pairs |= (one == ord("l")) & (two == ord("l"))
        symbols[quotes[short | pairs]] = S_QUOTE
        symbols[quotes[short] + 1] = S_CLOSING
        symbols[quotes[pairs] + 2] = S_CLOSING
    reset = opens[:-1]
    after = _prefix_states(_CODES[symbols + RESET * reset.astype(np.uint8)])
    before = np.zeros(n, np.uint8)
    before[1:] = after[:-1]
    bounds = np.flatnonzero(_STARTS[(before << 3) | symbols] | reset)
    counts = np.searchsorted(bounds, firsts)
    return joined, points, np.r_[bounds, n], counts


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, made once for a length."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grown = []
            for base in (HASH_BASE, pow(HASH_BASE, -1, 1 << 64)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                grown.append(np.multiply.accumulate(steps))
            self.up, self.down = grown
        return self.up, self.down


class PieceCache:
    """Ids of pieces by hash, one entry a slot; lookups of a batch are array operations.

    ``merge`` gives flat ids and counts of a list of pieces that are not cached. Two
    pieces count as one only if a 64-bit hash, the length and three characters agree.
    Pieces of over ``LONGEST_CACHED`` characters are never cached.
    """

    def __init__(self, merge: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bits: int = CACHE_BITS):
        self.merge, self.shift, self.powers = merge, np.uint64(64 - bits), _Powers()
        self.keys = np.zeros((2, 1 << bits), np.uint64)
        self.places = np.zeros(1 << bits, np.int64)
        self.sizes = np.zeros(1 << bits, np.int64)
        self.pool = np.zeros(POOL_IDS, np.int32)
        self.used = 0

    def _room(self, ids: int) -> bool:
        """Whether so many ids still fit; if not, the cache starts anew with room for them."""
        if self.used + ids <= len(self.pool):
            return True
        self.keys[:] = 0
        self.used = 0
        if ids > len(self.pool):
            self.pool = np.zeros(ids, np.int32)
        return False

    def ids(self, joined: str, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces and the number of ids of each."""
        a, b = bounds[:-1], bounds[1:]
        if not len(a):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        up, down = self.powers.of(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint32(1)) * up[: len(points)], out=sums[1:])
        hashes = (sums[b] - sums[a]) * down[a]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        check = points[a].astype(np.uint64) | (points[b - 1].astype(np.uint64) << np.uint64(21))
        check ^= points[(a + b) >> 1].astype(np.uint64) << np.uint64(42)
        check ^= (b - a + 1).astype(np.uint64) << np.uint64(48)
        slots = hashes >> self.shift
        hit = (self.keys[0][slots] == hashes) & (self.keys[1][slots] == check)
        short = b - a <= LONGEST_CACHED
        hit &= short
        missing = np.flatnonzero(~hit)
        if not self._room(4 * int((b - a)[missing].sum())):  # a character has four bytes at most
            missing = np.arange(len(a))
            self._room(4 * len(points))
        places, sizes = self.places[slots], self.sizes[slots]
        if len(missing):
            unlike = hashes[missing] ^ (check[missing] * np.uint64(0xD6E8FEB86659FD93))
            unlike[~short[missing]] = missing[~short[missing]]
            _, first, back = np.unique(unlike, return_index=True, return_inverse=True)
            wanted = missing[first]
            new, counts = self.merge([joined[i:j] for i, j in zip(a[wanted].tolist(), b[wanted].tolist())])
            at = self.used + np.r_[0, np.cumsum(counts)][:-1]
            self.pool[self.used : self.used + len(new)] = new
            self.used += len(new)
            places[missing], sizes[missing] = at[back], counts[back]
            cached = short[wanted]
            w = wanted[cached]
            self.keys[0][slots[w]], self.keys[1][slots[w]] = hashes[w], check[w]
            self.places[slots[w]], self.sizes[slots[w]] = at[cached], counts[cached]
        total = np.r_[0, np.cumsum(sizes)]
        source = np.repeat(places - total[:-1], sizes)
        source += np.arange(len(source))
        return self.pool[source], sizes


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece of any length: the pair of lowest rank merges, leftmost first.

    A heap holds the pairs, links hold the order of parts.
    """
    n = len(piece)
    ends, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = right[i] if left[i] != -2 else n
        if j >= n or ends[j] != end:
            continue  # one of the two has merged since
        ends[i], left[j] = end, -2
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(piece[i : ends[k]])) is not None:
                heapq.heappush(heap, (r, i, ends[k]))
        if (k := left[i]) >= 0 and (r := ranks.get(piece[k:end])) is not None:
            heapq.heappush(heap, (r, k, end))
    return [ranks[piece[i : ends[i]]] for i in range(n) if left[i] != -2]


class PairMerger:
    """Merges many pieces at once: one pair of every piece in each round."""

    def __init__(self, ranks: dict[bytes, int], pairs: np.ndarray):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(pairs)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NEVER, np.int64)
        keys, values = pairs[:, 0], pairs[:, 1]
        slots = self._slot(keys)
        while len(keys):  # those that find a free slot stay, the others go to the next
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            stays = free & (self.keys[slots] == keys)
            self.values[slots[stays]] = values[stays]
            keys, values, slots = keys[~stays], values[~stays], self._next(slots[~stays])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slots: np.ndarray) -> np.ndarray:
        return (slots + 1) & ((1 << self.bits) - 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 32) | b
        out = np.full(len(keys), NEVER, np.int64)
        open_, slots = np.arange(len(keys)), self._slot(keys)
        while len(open_):
            found = self.keys[slots]
            same = found == keys[open_]
            out[open_[same]] = self.values[slots[same]]
            more = ~same & (found >= 0)
            open_, slots = open_[more], self._next(slots[more])
        return out

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in pieces]
        whole = np.array([self.ranks.get(p, -1) for p in raw], np.int64)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        results: list = [None] * len(raw)
        for i in np.flatnonzero(whole >= 0).tolist():
            results[i] = whole[i : i + 1]
        rest = np.flatnonzero(whole < 0)
        for i in rest[sizes[rest] > WIDEST].tolist():
            results[i] = np.array(merge_pairs(raw[i], self.ranks), np.int64)
        rest = rest[sizes[rest] <= WIDEST]
        rest = rest[np.argsort(sizes[rest], kind="stable")]
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for i, ids in zip(some.tolist(), self._merge([raw[i] for i in some.tolist()], sizes[some])):
                results[i] = ids
        counts = np.fromiter(map(len, results), np.int64, len(results))
        return np.concatenate(results).astype(np.int32), counts

    def _merge(self, pieces: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
        n, width = len(pieces), int(sizes.max())
        used = np.arange(width) < sizes[:, None]
        ids = np.zeros((n, width + 1), np.int64)
        ids[:, :width][used] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        alive = np.zeros((n, width + 1), bool)
        alive[:, :width] = used
        # Place of the part before and after each; width stands for none.
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[np.arange(n), sizes - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        costs = np.full((n, width + 1), NEVER, np.int64)
        pairs = used[:, 1:]
        rows, places = np.nonzero(pairs)
        costs[rows, places] = self._rank(ids[rows, places], ids[rows, places + 1])
        active = np.arange(n)
        while len(active):
            at = costs[active].argmin(axis=1)
            low = costs[active, at]
            go = low < NEVER
            active, at, low = active[go], at[go], low[go]
            gone = after[active, at]
            following, leading = after[active, gone], before[active, at]
            ids[active, at] = low
            alive[active, gone] = False
            costs[active, gone] = NEVER
            after[active, at] = following
            before[active, following] = at
            for first, second in ((at, following), (leading, at)):
                real = (first < width) & (second < width)
                fresh = np.full(len(active), NEVER, np.int64)
                r = active[real]
                fresh[real] = self._rank(ids[r, first[real]], ids[r, second[real]])
                costs[active, first] = fresh
            costs[active, width] = NEVER
        flat = ids[alive]
        return np.split(flat, np.cumsum(alive.sum(axis=1))[:-1])


def mergeable_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """(pair of ids, rank) for every two tokens whose bytes together are a token."""
    rows = [
        ((a << 32) | b, rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None
    ]
    return np.array(rows, np.int64).reshape(-1, 2)


def encode_texts(texts: list[str], table: np.ndarray, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and the number of ids of each text."""
    parts, firsts = segments(texts)
    joined, points, bounds, counts = pre_tokenise(parts, table)
    ids, sizes = cache.ids(joined, points, bounds)
    total = np.r_[0, np.cumsum(sizes)]
    return ids, np.diff(total[counts[firsts]])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Vocabulary:
    """Bytes of all ids in one array, with the place and length of each."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.places = np.r_[0, np.cumsum(self.lengths)][:-1]
        by_id = sorted(ranks, key=ranks.get)
        self.data = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bytes of ids that end at the given offsets, the first starting at 0."""
        sizes = self.lengths[ids]
        starts = ends - sizes
        if len(ids) and (starts[0] or (starts[1:] != ends[:-1]).any()):
            raise ValueError("offsets do not fit the ids")
        source = np.repeat(self.places[ids] - starts, sizes)
        source += np.arange(len(source))
        return self.data[source]


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema if f.name.lower() not in names] + list(fields))


_INTS = T.ArrayType(T.IntegerType(), False)


def encode(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``ends``, the byte offset in the text where each id ends.

    The rank file is read by every task, as a file that all machines have.
    """
    kept = docs.drop("ids", "ends")
    runs = tiktoken_classes()
    pairs = mergeable_pairs(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        table, cache = class_table(runs), PieceCache(PairMerger(ranks, pairs))
        lengths = Vocabulary(ranks).lengths
        for batch in tidy(batches):
            for part in slices(batch, BATCH_BYTES, text):
                ids, counts = encode_texts(texts_of(part, text), table, cache)
                ends = np.cumsum(lengths[ids])
                last = np.r_[0, ends][np.r_[0, np.cumsum(counts)][:-1]]
                ends = (ends - np.repeat(last, counts)).astype(np.int32)
                columns = [*part.columns, lists(ids, counts), lists(ends, counts)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "ids", "ends"])

    schema = _with(kept.schema, T.StructField("ids", _INTS), T.StructField("ends", _INTS))
    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, keep: list[str] | None = None) -> DataFrame:
    """``decoded`` bytes from ``ids`` and ``ends``, beside the columns of ``keep``."""
    names = [c for c in (keep if keep is not None else encoded.columns) if c != "decoded"]
    source = encoded.select(*names, *[c for c in ("ids", "ends") if c not in names])
    schema = _with(source.select(*names).schema, T.StructField("decoded", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(read_ranks(ranks_path))
        for batch in tidy(batches):
            ids, ends = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "ends"))
            out = []
            for i in range(batch.num_rows):
                a, b = ids[i], ends[i]
                out.append(
                    words.decode(np.asarray(a.values), np.asarray(b.values).astype(np.int64)).tobytes()
                    if a.is_valid
                    else b""
                )
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, keep: list[str] | None = None) -> DataFrame:
    """Ids and decoded bytes of each document as counts and digests, made by Spark functions.

    Columns: those of ``keep`` (``doc_id`` if not given), n_tokens, ids_sha256,
    decoded_sha256.
    """
    keep = keep if keep is not None else ["doc_id"]
    columns = list(dict.fromkeys([*keep, "text"]))
    source = docs.select(*columns)
    fields = [T.StructField("ids", _INTS), T.StructField("decoded", T.BinaryType())]
    schema = T.StructType([*source.select(*keep).schema, *fields])
    runs = tiktoken_classes()
    pairs = mergeable_pairs(read_ranks(ranks_path))

    # Both ways in one pass: a second Python stage behind the first would double the workers.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        table, cache, words = class_table(runs), PieceCache(PairMerger(ranks, pairs)), Vocabulary(ranks)
        for batch in tidy(batches):
            for part in slices(batch, BATCH_BYTES):
                ids, counts = encode_texts(texts_of(part), table, cache)
                bounds = np.r_[0, np.cumsum(counts)]
                decoded = []
                for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = ids[first:last]
                    decoded.append(words.decode(own, np.cumsum(words.lengths[own])).tobytes())
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                arrays = [*kept, lists(ids, counts), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "ids", "decoded"])

    return source.mapInArrow(run, schema).select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
