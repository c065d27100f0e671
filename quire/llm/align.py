"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens meet.

Method. Both tokenizers cover a text's bytes without gaps, so each gives an ascending list of byte
offsets where its tokens end. The shorter list of a document drives: each of its ends is
sought in the longer one, by steps that double from where the end before it was found and a
binary search in the last step. Ends in both lists cut the tokens into groups. The rank where an
end falls, less the rank of the end before, is the range of tokens of the other side
that a token overlaps; these are its links. All documents of a batch are
searched at once: every second end starts from its neighbour's place, level by level.

How many documents hold a pair linked is counted over the whole corpus. Documents are taken in blocks of
bounded size. A block sends each of its distinct pairs once, with the number of its documents, and
gets the corpus' count back once, however often the pair stands in it. The links themselves wait in
a written table, as numbers of pairs within their block.

Encoding. A text is cut where neither tokenizer merges over the place (``piece_pattern``), and pieces met before are
remembered. Tokenizer A, of the tokenizers library, reads a space and the
text; B, of sentencepiece, puts that space itself. B's pieces may hold a space at their start alone;
for a model with others, texts are encoded whole.

Edge cases. A null or empty text, and one whose bytes a tokenizer does not give back, has no
tokens, groups or links. Long texts are handled whole. Repeated rows are documents of their own. A null doc_id
stays null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lists, pack_columns, slices, texts_of, tidy, unpack_columns
from quire.llm.packing import byte_letters
from quire.session import materialize

BATCH_BYTES = 1 << 19
BLOCK_BYTES = 8 << 20
CACHE_PIECES = 1 << 17
LONGEST_REMEMBERED = 64
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"  # letters by every version of Unicode
_ENDS = ",.;:!?|\n"  # what may stand after a word
_WORD = re.compile(f" ?[{_LATIN}]+")


def piece_pattern(ends: str) -> re.Pattern:
    """Pieces of a text, from cut to cut: a word and what is no plain word up to the next cut.

    A cut is before a space that is not the last character and follows something else than white space, and between a
    letter and one of ``ends``. Before the first kind stands no white space of any reading, so that a run of it is never
    cut; a last space stays with its piece, since B would give nothing for it alone.
    """
    between = f"(?<=[{_LATIN}])[{re.escape(ends)}]" if ends else "(?!)"
    after = f"[{re.escape(ends)}]| .|\\Z" if ends else " .|\\Z"
    return re.compile(
        f" ?[{_LATIN}]+(?={after})|.(?:(?!(?<=[^\\s\u180e]) .|{between}).)*", re.S
    )


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Place in ``long`` of the first value not below each of ``short``; both ascend.

    No value of ``short`` is above the last one of ``long``.
    """
    n = len(short)
    place = np.zeros(n, np.int64)
    if not n:
        return place
    place[:1] = _seek(short[:1], long, np.zeros(1, np.int64))
    stride = 1 << max(0, (n - 1).bit_length() - 1)
    while stride:
        at = np.arange(stride, n, 2 * stride)
        place[at] = _seek(short[at], long, place[at - stride])
        stride >>= 1
    return place


def _seek(values: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places of the values, none of them before ``start``."""
    low, high = start.copy(), start.copy()
    step, open_ = 1, np.flatnonzero(long[start] < values)
    while len(open_):
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(high[open_] + step, len(long) - 1)
        step *= 2
        open_ = open_[long[high[open_]] < values[open_]]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = long[middle] < values[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def overlaps(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last token of the longer side that each of the shorter overlaps, and whether both end there.

    Takes the ends of the tokens of both sides, which cover the same bytes.
    """
    last = gallop(short, long)
    common = long[last] == short if len(short) else np.zeros(0, bool)
    first = np.r_[0, (last + common)[:-1]] if len(short) else last
    return first, last, common


class Pieces:
    """Ids and byte lengths of both tokenizers' tokens of pieces of text."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a_size, self.b_size = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        values = {letter: byte for byte, letter in byte_letters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_size = max(self.a_size, max(vocabulary.values()) + 1)
        self.a_bytes = [b""] * self.a_size
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(values.__getitem__, token)) if all(c in values for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)
        ]
        self.whole = any("▁" in p.lstrip("▁") for p in names)
        # Cut only where no piece of B spans the cut.
        inside = "\n".join(names) if not self.whole else ""
        ends = "".join(c for c in _ENDS if not re.search(f"[{_LATIN}]{re.escape(c)}.", inside.replace("\n", "\n\n")))
        self.pieces = piece_pattern(ends).findall
        self.model, self.letters = self.a.model, byte_letters()
        self.carrier = len(self.b.encode("a"))
        self.lengths = [np.array([len(b) for b in own], np.int64) for own in (self.a_bytes, self.b_bytes)]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.right, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)

    def _thin(self) -> None:
        """Keep the pieces that came most often, at most half as many as may be kept."""
        order = np.argsort(-self.uses, kind="stable")[: CACHE_PIECES // 2]
        kept = np.sort(order[self.uses[order] > 1])
        names = list(self.known)
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}
        for side in (0, 1):
            starts, sizes = self.ends[side][kept], np.diff(self.ends[side])[kept]
            ends = np.cumsum(sizes)
            self.ids[side] = self.ids[side][np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
            self.ends[side] = np.r_[0, ends]
        self.right, self.uses = self.right[kept], self.uses[kept] // 2

    def _learn(self, pieces: list[str]) -> None:
        # A plain word is one pre-token of A, which its model takes in byte letters.
        plain = [_WORD.fullmatch(p) is not None for p in pieces]
        other = iter(self.a.encode_batch_fast([p for p, w in zip(pieces, plain) if not w], add_special_tokens=False))
        letters, tokenize = self.letters, self.model.tokenize
        a = [
            [t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))] if w else next(other).ids
            for p, w in zip(pieces, plain)
        ]
        # B puts a space before what it is given; a piece without one comes behind a letter, which it does not join.
        spaced = [p[0] == " " for p in pieces]
        b = self.b.encode([p[1:] if s else "a" + p for p, s in zip(pieces, spaced)], num_threads=1)
        found = [a, [ids if s else ids[self.carrier :] for ids, s in zip(b, spaced)]]
        raw = [p.encode() for p in pieces]
        sizes, joined = np.fromiter(map(len, raw), np.int64, len(raw)), b"".join(raw)
        right = np.ones(len(pieces), bool)
        for side, own in enumerate(found):
            names = (self.a_bytes, self.b_bytes)[side]
            counts = np.fromiter(map(len, own), np.int64, len(own))
            ends = np.cumsum(counts)
            flat = np.fromiter(chain.from_iterable(own), np.int32, int(counts.sum()))
            lengths = np.diff(np.r_[0, np.cumsum(self.lengths[side][flat])][np.r_[0, ends]])
            if (lengths != sizes).any() or b"".join(map(names.__getitem__, flat.tolist())) != joined:
                right &= [b"".join(map(names.__getitem__, ids)) == r for ids, r in zip(own, raw)]
            self.ids[side] = np.concatenate([self.ids[side], flat])
            self.ends[side] = np.concatenate([self.ends[side], self.ends[side][-1] + ends])
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.right = np.concatenate([self.right, right])
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), np.int64)])

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all texts and the number of each text, for A and for B; none for a text not given back."""
        if len(self.known) > CACHE_PIECES:
            self._thin()
        cut = (lambda t: [t]) if self.whole else self.pieces
        parts = [cut(" " + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        found = list(map(self.known.get, flat))
        new = list({p for p, i in zip(flat, found) if i is None})
        if new:
            self._learn(new)
            found = [self.known[p] if i is None else i for p, i in zip(flat, found)]
        place = np.array(found, np.int64)
        self.uses += np.bincount(place, minlength=len(self.uses))
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        bad = np.bincount(owner, ~self.right[place], len(texts)) > 0
        place, owner = place[~bad[owner]], owner[~bad[owner]]
        ids, counts = [], []
        for side in (0, 1):
            starts = self.ends[side][place]
            sizes = self.ends[side][place + 1] - starts
            before = np.cumsum(sizes) - sizes
            ids.append(self.ids[side][np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))])
            counts.append(np.bincount(owner, sizes, len(texts)).astype(np.int64))
        if any(len(p) > LONGEST_REMEMBERED for p in new):
            self._forget()  # long pieces are not kept
        return ids, counts


class Aligned:
    """Tokens, groups and links of a batch of texts."""

    def __init__(self, pieces: Pieces, texts: list[str]):
        self.ids, self.counts = pieces(texts)
        self.texts = len(texts)
        first = [np.r_[0, np.cumsum(c)] for c in self.counts]
        a_shorter = self.counts[0] <= self.counts[1]
        ends = [np.cumsum(pieces.lengths[s][self.ids[s]]) for s in (0, 1)]
        owners = [np.repeat(np.arange(self.texts), c) for c in self.counts]
        links, self.closes = [], [np.zeros(len(i), bool) for i in self.ids]
        for chosen, short in ((a_shorter, 0), (~a_shorter, 1)):
            tokens = [np.flatnonzero(chosen[o]) for o in owners]
            x, y = tokens[short], tokens[1 - short]
            if not len(x):
                continue
            low, high, common = overlaps(ends[short][x], ends[1 - short][y])
            self.closes[short][x[common]] = True
            self.closes[1 - short][y[high[common]]] = True
            sizes = high - low + 1
            before = np.cumsum(sizes) - sizes
            there = y[np.repeat(low - before, sizes) + np.arange(int(sizes.sum()))]
            here = np.repeat(x, sizes)
            links.append((here, there) if short == 0 else (there, here))
        pairs = [np.concatenate([l[s] for l in links]) if links else np.zeros(0, np.int64) for s in (0, 1)]
        order = np.lexsort((pairs[1], pairs[0])) if len(links) > 1 else slice(None)
        self.links = [p[order] for p in pairs]  # numbers of tokens in the batch
        self.first = first
        self.link_owner = owners[0][self.links[0]]
        self.n_links = np.bincount(self.link_owner, minlength=self.texts)
        self.n_groups = np.bincount(owners[0], self.closes[0], self.texts).astype(np.int64)

    def cuts(self, side: int) -> np.ndarray:
        """For each group, the number of tokens of its text up to its end."""
        closing = np.flatnonzero(self.closes[side])
        owner = np.searchsorted(self.first[side], closing, side="right") - 1
        return closing + 1 - self.first[side][owner]

    def described(self, digits: tuple[np.ndarray, np.ndarray]) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2`` of each text: ids of groups, of A and of B."""
        table, widths = digits
        group_of = [np.r_[0, np.cumsum(c)[:-1]] if len(c) else np.zeros(0, np.int64) for c in self.closes]
        upto = [np.r_[0, np.flatnonzero(c) + 1] for c in self.closes]
        places = [
            np.arange(len(self.ids[0])) + upto[1][group_of[0]],
            np.arange(len(self.ids[1])) + upto[0][group_of[1] + 1] if len(self.ids[1]) else np.zeros(0, np.int64),
        ]
        total = len(self.ids[0]) + len(self.ids[1])
        ids, marks = np.zeros(total, np.int32), np.full(total, ord(","), np.uint8)
        for side, mark in ((0, "|"), (1, ";")):
            ids[places[side]] = self.ids[side]
            marks[places[side][self.closes[side]]] = ord(mark)
        rows, sizes = table[ids], widths[ids]
        rows[np.arange(total), sizes] = marks
        text = rows[np.arange(rows.shape[1]) <= sizes[:, None]].tobytes()
        ends = np.cumsum(sizes + 1)
        bounds = np.r_[0, ends][self.first[0] + self.first[1]]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield text[a : max(a, b - 1)]


def decimal_digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below ``size`` in rows, with room for a mark, and how many each has."""
    texts = [str(i).encode() for i in range(size)]
    widest = len(texts[-1]) + 1
    table = np.frombuffer(b"".join(t.ljust(widest, b"\0") for t in texts), np.uint8).reshape(size, widest)
    return table, np.fromiter(map(len, texts), np.int64, size)


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Tokens, groups and links of each document.

    Columns: doc_id; a_ids, b_ids; a_cuts, b_cuts (for each group, the tokens of A and of B up to its
    end); link_a, link_b (numbers of linked tokens in the document, from 0).
    """
    names = ["a_ids", "b_ids", "a_cuts", "b_cuts", "link_a", "link_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(a_file, b_file)
        for batch in tidy(batches):
            for part in slices(batch, BATCH_BYTES):
                found = Aligned(pieces, texts_of(part))
                columns = [part.column(part.schema.get_field_index("doc_id"))]
                columns += [lists(found.ids[s], found.counts[s]) for s in (0, 1)]
                columns += [lists(found.cuts(s).astype(np.int32), found.n_groups) for s in (0, 1)]
                own = [found.links[s] - found.first[s][found.link_owner] for s in (0, 1)]
                columns += [lists(o.astype(np.int32), found.n_links) for o in own]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} array<int>" for n in names))


_REPORT = ["n_a", "n_b", "n_groups", "n_links"]


class _Block:
    """Documents of a block: their figures and links."""

    def __init__(self) -> None:
        self.doc_ids: list = []
        self.figures: list[np.ndarray] = []
        self.hashes: list[str] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.distinct: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_ids: list, found: Aligned, hashes: list[str], keys: np.ndarray, span: int, size: int) -> None:
        # Distinct pairs of each document, and how often it has them.
        own, times = np.unique(found.link_owner * span + keys, return_counts=True)
        self.distinct.append(np.bincount(own // span, minlength=found.texts))
        self.keys.append(own % span)
        self.times.append(times)
        self.doc_ids += doc_ids
        self.figures.append(np.stack([*found.counts, found.n_groups, found.n_links]))
        self.hashes += hashes
        self.bytes += size

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        keys, place, docs = np.unique(np.concatenate(self.keys), return_inverse=True, return_counts=True)
        distinct = np.concatenate(self.distinct)
        steps = np.diff(place, prepend=0).astype(np.int32)  # small and often alike
        links = pack_columns(steps, np.concatenate(self.times).astype(np.int32))
        figures = np.concatenate(self.figures, axis=1).astype(np.int64)
        n = np.array([len(self.doc_ids)])
        columns = [pa.array([number]), lists(keys, np.array([len(keys)])), lists(docs.astype(np.int32), np.array([len(keys)]))]
        columns += [pa.array([links], pa.binary()), lists(distinct.astype(np.int32), n)]
        columns += [pa.array([self.doc_ids], pa.list_(kind)), *(lists(f, n) for f in figures), pa.array([self.hashes])]
        return pa.RecordBatch.from_arrays(
            columns, ["block", "keys", "docs", "links", "distinct", "doc_ids", *_REPORT, "groups_sha256"]
        )


def blocks(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Aligned documents in blocks, with the distinct linked pairs of each block and in how many documents they are."""

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces = Pieces(a_file, b_file)
        span = pieces.a_size * pieces.b_size
        digits = decimal_digits(max(pieces.a_size, pieces.b_size))
        number, block, type_ = TaskContext.get().partitionId() << 32, _Block(), pa.int64()
        for batch in tidy(batches):
            for part in slices(batch, BATCH_BYTES):
                texts = texts_of(part)
                found = Aligned(pieces, texts)
                keys = found.ids[0][found.links[0]].astype(np.int64) * pieces.b_size + found.ids[1][found.links[1]]
                hashes = [hashlib.sha256(t).hexdigest() if t else "" for t in found.described(digits)]
                column = part.column(part.schema.get_field_index("doc_id"))
                type_ = column.type
                block.add(column.to_pylist(), found, hashes, keys, span, sum(map(len, texts)))
                if block.bytes >= BLOCK_BYTES:
                    yield block.row(number, type_)
                    number, block = number + 1, _Block()
        if block.doc_ids:
            yield block.row(number, type_)

    figures = ", ".join(f"{n} array<long>" for n in _REPORT)
    return docs.select("doc_id", "text").mapInArrow(
        run,
        "block long, keys array<long>, docs array<int>, links binary, distinct array<int>, "
        f"doc_ids array<{kind}>, {figures}, groups_sha256 array<string>",
    )


def link_counts(made: DataFrame, b_size: int) -> DataFrame:
    """key, a, docs, best: in how many documents a pair is linked, and whether no other pair of its A id is in more."""
    pairs = made.select(F.explode(F.arrays_zip("keys", "docs")).alias("p"))
    counts = pairs.groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.docs").alias("docs"))
    counts = counts.withColumn("a", F.expr(f"key div {b_size}"))
    # One row for each id of A, so the size of its vocabulary bounds it.
    top = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(F.broadcast(top), "a").select("key", "a", "docs", (F.col("docs") == F.col("most")).alias("best"))


def report(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Figures of each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts links whose pair is in as many documents as any of its A id; ``count_sum``
    adds the documents of the pairs over all links.
    """
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()
    made = materialize(blocks(docs, a_file, b_file), "aligned-blocks")
    counts = materialize(link_counts(made, b_size), "link-counts")
    asked = made.select(F.col("block").alias("asking"), F.posexplode("keys").alias("place", "key"))
    answers = asked.join(counts.select("key", "docs", "best"), "key").select("asking", "place", "docs", "best")
    waiting = made.drop("keys", "docs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *_REPORT, "n_best", "count_sum", "groups_sha256"]

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        docs_of, best_of = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        docs_of[place] = right.column("docs").to_numpy()
        best_of[place] = right.column("best").to_numpy(zero_copy_only=False)
        row = {n: left.column(n)[0] for n in left.column_names}
        steps, times = unpack_columns(row["links"].as_py(), "i4", "i4")
        pair = np.cumsum(steps)
        bounds = np.r_[0, np.cumsum(row["distinct"].values.to_numpy())]
        sums = [np.r_[0, np.cumsum(times * of[pair])][bounds] for of in (best_of, docs_of)]
        columns = [row["doc_ids"].values, *(row[n].values for n in _REPORT)]
        columns += [pa.array(np.diff(s).astype(np.int64)) for s in sums]
        return pa.Table.from_arrays([*columns, row["groups_sha256"].values], names)

    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", groups_sha256 string"
    return waiting.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(settle, schema)
