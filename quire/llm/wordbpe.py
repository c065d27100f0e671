"""Encoding and decoding with a BPE of word ends, by dynamic programming over prefixes.

Method. A word is a row of symbols: its bytes, the last one marked as the end of the word. What the
merges make of a prefix ends in one token, and that token is the only one, among those
that end there, which the merges leave standing beside the last token of what is before it. So a
word is encoded from left to right: an automaton of all tokens with suffix links gives the tokens that end
at a symbol, longest first; a test of the pair of neighbours, on the merges that made both, finds the one to
store for the prefix. Pointers back from the end give the ids. Nothing is merged. The time of a
word grows with its length, whatever it holds; words of a batch are done side by side.

The pair test undoes, latest first, the merges that made the two tokens, and looks whether a pair
across the boundary would have been merged before. Tokens that their own merges never
give are left out of the automaton by the same test.

Texts are cut at added tokens, normalised and split into words as the file says. The library
itself tells the class and lower case of each code point and composes texts with marks; the
boundaries come from array operations. Decoding joins the tokens by spaces, as the library does for a file
without a decoder.

Edge cases. A null or empty text has no ids and decodes to an empty text, as does one of white space alone.
Long texts and words are handled whole. Repeated rows stay. Other columns pass through; columns named
``ids`` or ``decoded`` are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import lists, slices, texts_of, tidy
from quire.llm.packing import byte_letters

BATCH_BYTES = 1 << 20
SIDE_BY_SIDE = 64  # symbols of the longest word that is done beside others
CACHE_WORDS = 1 << 18
CACHE_IDS = 1 << 21
_MARK = 256  # added to the last byte of a word
_SYMBOLS = 512
_NEVER = 1 << 30
WHITE, LETTER, NUMBER, OTHER = range(4)

NORMALIZER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Merges:
    """Tokens of a tokenizer file, the merges that made them, and the automaton of their symbols."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as file:
            described = json.load(file)
        _check(described)
        model = described["model"]
        end, vocabulary = model["end_of_word_suffix"], model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        values = {letter: byte for byte, letter in byte_letters().items()}

        self.size = max(vocabulary.values()) + 1
        self.rank = np.full(self.size, -1, np.int64)  # of the merge that makes a token; -1 for a symbol
        self.left = np.zeros(self.size, np.int64)
        self.right = np.zeros(self.size, np.int64)
        pairs = np.zeros((len(merges), 2), np.int64)
        made = np.zeros(len(merges), np.int64)
        for rank, (a, b) in enumerate(merges):
            pairs[rank] = vocabulary[a], vocabulary[b]
            made[rank] = vocabulary[a + b]
        if len(np.unique(made)) < len(made):
            raise ValueError("two merges make one token")
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), pairs[:, 0], pairs[:, 1]
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, _NEVER)

        used = np.zeros(self.size, bool)
        used[made] = self.compatible(pairs[:, 0], pairs[:, 1], np.arange(len(made)))
        symbols: dict[int, tuple[int, ...]] = {}
        for token, i in vocabulary.items():
            last = token.endswith(end) and len(token) > len(end)
            own = [values.get(c) for c in (token[: -len(end)] if last else token)]
            if None in own:
                continue
            if last:
                own[-1] += _MARK
            if len(own) == 1:
                used[i] = True
            if used[i]:
                symbols[i] = tuple(own)
        if len({s for s in symbols.values() if len(s) == 1}) < _SYMBOLS:
            raise ValueError("the vocabulary lacks a symbol")
        self._automaton(symbols)

    def _automaton(self, symbols: dict[int, tuple[int, ...]]) -> None:
        go: dict[int, int] = {}
        token, depth, came = [-1], [0], [(0, 0)]
        for i, own in symbols.items():
            state = 0
            for s in own:
                following = go.get(state * _SYMBOLS + s)
                if following is None:
                    following = go[state * _SYMBOLS + s] = len(token)
                    token.append(-1)
                    depth.append(depth[state] + 1)
                    came.append((state, s))
                state = following
            token[state] = i
        link, first = [0] * len(token), [0] * len(token)
        for state in sorted(range(1, len(token)), key=depth.__getitem__):
            parent, s = came[state]
            if parent:
                back = link[parent]
                while (following := go.get(back * _SYMBOLS + s)) is None and back:
                    back = link[back]
                link[state] = following or 0
            first[state] = state if token[state] >= 0 else first[link[state]]
        self.go, self.link, self.first = go, np.array(link), np.array(first)
        self.token, self.depth = np.array(token), np.array(depth)
        # The longest token that ends in a state, and the next shorter one.
        self.shorter = self.first[self.link]
        keys = np.fromiter(go, np.int64, len(go))
        order = np.argsort(keys)
        self.go_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.go_states = np.append(np.fromiter(go.values(), np.int64, len(go))[order], 0)
        self.known: dict[int, bool] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int = _NEVER) -> np.ndarray:
        """Whether the merges leave tokens a and b as they are side by side.

        With ``limit``, only merges of lower rank across the boundary count.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.broadcast_to(np.asarray(limit, np.int64), len(a))
        while len(at):
            key = a * self.size + b
            place = np.searchsorted(self.pair_keys, key)
            crossing = np.where(self.pair_keys[place] == key, self.pair_ranks[place], _NEVER)
            merged = crossing < limit
            ok[at[merged]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~merged & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            # Of equal pairs the left one is merged first: a tie goes to the pair further left.
            in_left = ra > rb
            limit = np.where(in_left, ra, rb + 1)
            a, b = np.where(in_left, self.right[a], a), np.where(in_left, b, self.left[b])
        return ok

    def _pair(self, a: int, b: int) -> bool:
        key = a * self.size + b
        found = self.known.get(key)
        if found is None:
            if len(self.known) > CACHE_IDS:
                self.known.clear()
            found = self.known[key] = bool(self.compatible(np.array([a]), np.array([b]))[0])
        return found

    def _follow(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(states), np.int64)
        at = np.arange(len(states))
        while len(at):
            key = states * _SYMBOLS + symbols
            place = np.searchsorted(self.go_keys, key)
            hit = self.go_keys[place] == key
            out[at[hit]] = self.go_states[place[hit]]
            go = ~hit & (states > 0)
            at, symbols, states = at[go], symbols[go], self.link[states[go]]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each; no word is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[ends - 1] += _MARK
        last = np.zeros(len(symbols), np.int64)  # of each prefix, at the place of its last symbol
        for i in np.flatnonzero(sizes > SIDE_BY_SIDE).tolist():
            a, b = int(ends[i] - sizes[i]), int(ends[i])
            last[a:b] = self._one(symbols[a:b].tolist())
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] <= SIDE_BY_SIDE]
        starts, lengths = (ends - sizes)[order], sizes[order]
        states = np.zeros(len(order), np.int64)
        for i in range(int(lengths[0]) if len(order) else 0):
            open_ = int(np.searchsorted(-lengths, -i, side="left"))  # words longer than i
            at = starts[:open_] + i
            states = self._follow(states[:open_], symbols[at])
            ending = self.first[states]
            left = np.arange(open_)
            while len(left):
                candidate, size = self.token[ending], self.depth[ending]
                fits = size == i + 1  # the token is the whole prefix
                rest = np.flatnonzero(~fits)
                before = last[at[left[rest]] - size[rest]]
                fits[rest] = self.compatible(before, candidate[rest])
                last[at[left[fits]]] = candidate[fits]
                left, ending = left[~fits], self.shorter[ending[~fits]]
        return self._back(last, sizes, ends)

    def _one(self, symbols: list[int]) -> list[int]:
        """Last token of each prefix of one long word."""
        go, link, first, shorter = self.go, self.link, self.first, self.shorter
        token, depth = self.token, self.depth
        state, last = 0, []
        for i, s in enumerate(symbols):
            while (following := go.get(state * _SYMBOLS + s)) is None and state:
                state = int(link[state])
            state = following or 0
            ending = int(first[state])
            while True:
                candidate, size = int(token[ending]), int(depth[ending])
                if size == i + 1 or self._pair(last[i - size], candidate):
                    last.append(candidate)
                    break
                ending = int(shorter[ending])
        return last

    def _back(self, last: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow the stored tokens from the end of each word to its start."""
        stands = np.zeros(len(last), bool)  # whether a token of the result ends here
        at, starts = ends - 1, ends - sizes
        lengths = np.zeros(self.size, np.int64)
        some = self.token >= 0
        lengths[self.token[some]] = self.depth[some]
        long = sizes > SIDE_BY_SIDE
        for i in np.flatnonzero(long).tolist():
            place, start = int(at[i]), int(starts[i])
            while place >= start:
                stands[place] = True
                place -= int(lengths[last[place]])
        at, starts = at[~long], starts[~long]
        while len(at):
            stands[at] = True
            at = at - lengths[last[at]]
            inside = at >= starts
            at, starts = at[inside], starts[inside]
        ids = last[stands].astype(np.int32)
        return ids, np.add.reduceat(stands.astype(np.int64), ends - sizes) if len(sizes) else np.zeros(0, np.int64)


def _check(described: dict) -> None:
    """Only files of the one kind that this module knows."""
    model, normalizer, splitter = (described[k] or {} for k in ("model", "normalizer", "pre_tokenizer"))
    kinds = [n["type"] for n in normalizer.get("normalizers", [])]
    first = (splitter.get("pretokenizers") or [{}])[0]
    known = (
        model.get("type") == "BPE"
        and bool(model.get("end_of_word_suffix"))
        and not any(model.get(k) for k in ("continuing_subword_prefix", "unk_token", "dropout", "ignore_merges"))
        and kinds == NORMALIZER
        and first.get("pattern", {}).get("Regex") == PATTERN
        and described.get("decoder") is None
    )
    if not known:
        raise ValueError("not a file of lower-case words with end marks")


class Splitter:
    """Words of texts, as the normaliser and the pattern of the file cut them."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer, normalizers

        library = Tokenizer.from_file(tokenizer_file)
        self.added = {t.content: i for i, t in library.get_added_tokens_decoder().items() if t.content}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.cuts = library.pre_tokenizer.pre_tokenize_str
        self.compose = normalizers.NFC().normalize_str
        self.lowered = normalizers.Lowercase().normalize_str
        self.lower = np.full(0x110000, -1, np.int32)  # -1: not met yet, -2: more than one code point
        self.kind = np.full(0x110000, -1, np.int8)

    def _kind_of(self, c: str) -> int:
        between = len(self.cuts(f"a{c}a"))
        if between == 1:
            return LETTER
        if between == 2:
            return WHITE
        return OTHER if len(self.cuts(f"!{c}!")) == 1 else NUMBER

    def _learn(self, points: np.ndarray) -> None:
        for p in np.unique(points).tolist():
            low = self.lowered(chr(p))
            self.lower[p] = ord(low) if len(low) == 1 else -2
            for c in low:
                if self.kind[ord(c)] < 0:
                    self.kind[ord(c)] = self._kind_of(c)

    def _points(self, parts: list[str]) -> np.ndarray:
        # White space ends each part; three places more can be looked at behind the last.
        return np.frombuffer(("\n".join(parts) + "\n\n\n\n").encode("utf-32-le"), np.uint32)

    def _normalised(self, parts: list[str]) -> np.ndarray:
        points = self._points(parts)
        if (points >= 0x300).any():  # nothing below takes part in a composition
            parts = [self.compose(p) if not p.isascii() else p for p in parts]
            points = self._points(parts)
        new = self.lower[points] == -1
        if new.any():
            self._learn(points[new])
        low = self.lower[points]
        several = low == -2
        if several.any():
            for c in map(chr, np.unique(points[several]).tolist()):
                parts = [p.replace(c, self.lowered(c)) for p in parts]
            return self._normalised_again(parts)
        return low

    def _normalised_again(self, parts: list[str]) -> np.ndarray:
        """Lower case of parts in which every code point has one; not composed a second time."""
        points = self._points(parts)
        new = self.lower[points] == -1
        if new.any():
            self._learn(points[new])
        return self.lower[points]

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words in order and how many each text has; ids and places (words before) of added tokens."""
        parts, owner, ids, after = [], [], [], []
        for i, text in enumerate(texts):
            pieces = self.cut.split(text) if self.cut and any(a in text for a in self.added) else [text]
            for k, piece in enumerate(pieces):
                if k % 2:
                    ids.append(self.added[piece])
                    after.append(len(parts))
                else:
                    parts.append(piece)
                    owner.append(i)
        low = self._normalised(parts)
        kind = self.kind[low]
        solid = kind != WHITE
        starts = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)] & solid
        mark = np.flatnonzero((low[:-3] == ord("'")) & starts[:-3] & (kind[1:-2] == LETTER))
        one, two = low[mark + 1], low[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.isin(one, [ord("r"), ord("v")]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for size, chosen in ((2, mark[short]), (3, mark[long])):
            starts[chosen + 1] = False
            rest = chosen + size
            starts[rest[kind[rest] == LETTER]] = True
        first = np.flatnonzero(starts)
        stops = np.flatnonzero(starts | ~solid)
        last = stops[np.searchsorted(stops, first, side="right")] if len(first) else first
        joined = low.astype("<u4").tobytes().decode("utf-32-le")
        words = [joined[a:b] for a, b in zip(first.tolist(), last.tolist())]
        # A part ends at its line break; inside it there may be others.
        lengths = self._lengths(low, parts)
        places = np.searchsorted(first, np.r_[0, np.cumsum(lengths)])
        counts = np.bincount(np.array(owner, np.int64), np.diff(places), len(texts)).astype(np.int64)
        return words, counts, np.array(ids, np.int64), places[np.array(after, np.int64)] if after else np.zeros(0, np.int64)

    def _lengths(self, low: np.ndarray, parts: list[str]) -> np.ndarray:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        if sizes.sum() + 3 == len(low):
            return sizes
        # Composed or longer in lower case: measured part by part.
        again = []
        for p in parts:
            p = self.compose(p) if not p.isascii() else p
            again.append(len(p) if p.isascii() else len(self.lowered(p)))
        return np.array(again, np.int64) + 1


@lru_cache(maxsize=2)
def merges_of(tokenizer_file: str) -> Merges:
    """Read once for each worker process."""
    return Merges(tokenizer_file)


class Encoder:
    """Ids of texts; words met before are remembered."""

    def __init__(self, tokenizer_file: str):
        self.merges = merges_of(tokenizer_file)
        self.split = Splitter(tokenizer_file)
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _places(self, words: list[str]) -> np.ndarray:
        known = self.words
        new = list({w for w in words if w not in known})
        if new:
            ids, counts = self.merges.encode([w.encode() for w in new])
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        if len(self.words) > CACHE_WORDS or len(self.ids) > CACHE_IDS:
            self._forget()
        words, counts, added, after = self.split(texts)
        place = self._places(words)
        starts, sizes = self.ends[place], self.ends[place + 1] - self.ends[place]
        before = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]
        totals = np.r_[0, np.cumsum(sizes)]
        bounds = totals[np.r_[0, np.cumsum(counts)]]
        per_text = np.diff(bounds)
        if len(added):
            ids = np.insert(ids, totals[after], added.astype(np.int32))
            owners = [i for i, t in enumerate(texts) for _ in (self.split.cut.findall(t) if any(a in t for a in self.split.added) else ())]
            per_text = per_text + np.bincount(np.array(owners, np.int64), minlength=len(texts))
        return ids, per_text


class Decoder:
    """Texts of ids: the tokens with a space between them."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer_file)
        self.tokens = {i: t for t, i in library.get_vocab(with_added_tokens=True).items()}

    def __call__(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def _schema(docs: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*docs.schema, *fields])


def _without(docs: DataFrame, *names: str) -> DataFrame:
    return docs.drop(*names)


def encode(docs: DataFrame, tokenizer_file: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``. The file is read by every task, as one that all machines have."""
    kept = _without(docs, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_file)
        for batch in tidy(batches):
            for part in slices(batch, BATCH_BYTES, text):
                ids, counts = encoder(texts_of(part, text))
                yield pa.RecordBatch.from_arrays([*part.columns, lists(ids, counts)], [*part.schema.names, "ids"])

    return kept.mapInArrow(run, _schema(kept, T.StructField("ids", T.ArrayType(T.IntegerType(), False))))


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``."""
    kept = _without(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokenizer_file)
        for batch in tidy(batches):
            ids = batch.column(batch.schema.get_field_index("ids"))
            out = [decoder(np.asarray(ids[i].values)) if ids[i].is_valid else "" for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, _schema(kept, T.StructField("decoded", T.StringType())))


def digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text, encoded and decoded in one pass."""
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    names = ["doc_id", *(f.name for f in fields)]
    kept = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(tokenizer_file), Decoder(tokenizer_file)
        for batch in tidy(batches):
            for part in slices(batch, BATCH_BYTES):
                ids, counts = encoder(texts_of(part))
                hashed, texts = [], []
                for own in np.split(ids, np.cumsum(counts)[:-1]):
                    hashed.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    texts.append(hashlib.sha256(decoder(own).encode()).hexdigest())
                key = part.column(part.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays([key, pa.array(counts), pa.array(hashed), pa.array(texts)], names)

    return kept.mapInArrow(run, T.StructType([kept.schema["doc_id"], *fields]))
