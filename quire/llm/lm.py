"""Language-model scores by deleted interpolation of bigrams.

Method. The probability of a word after another mixes three estimates: the relative frequency
of the pair among what follows the first word, that of the word in the corpus, and an
even share of the vocabulary with one place for the unknown. The weights depend on how
often the first word was seen (buckets by powers of two). They are learned by expectation-
maximisation on held-out counts: one part of the training texts (fold 1) is predicted by the
counts of the rest (fold 2). Scores then use the counts of both.

Counts are exact and cover all training texts. Documents are packed into blocks once. A block
sends each owner of a range of hashes the distinct words and pairs it holds, with their
numbers; an owner adds up what it gets from all blocks and answers each with the totals of what
it sent, in the same order. So a pair travels once a block, whatever its frequency, nothing is
held for the whole corpus anywhere, and common words make no task larger. Blocks are a bucketed
table, which the answers join in place. What
expectation-maximisation needs of the held-out pairs is a table of fixed size: their number by
bucket and by both frequencies in steps of a quarter of a power of two.

Words are what stands between ASCII white space, with A-Z in lower case; each text ends in an
end mark, which is also the first word's context.

Edge cases. A null or empty text is the end mark alone. Without training texts every score is
0. Without texts in fold 1 the weights are ``FIXED``. Long texts are read whole. Repeated rows
count as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bucketed, pack_columns, slices, texts_of, tidy, unpack_columns
from quire.llm.words import Hasher, mixed
from quire.session import materialize

SLICE_BYTES = 1 << 20
BLOCK_BYTES = 6 << 20
OWNER_KEYS = 700_000
BUCKETS = 20
STEPS = 4  # of a frequency, by power of two
NONE = -(1 << 20)  # step of a frequency of zero
ROUNDS = 60
FIXED = (0.3, 0.6, 0.1)
END = np.uint64(0x5EED0F5EED0F5EED)


def tokens(texts: list[str], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text followed by the end mark; tokens by text."""
    parts, counts, at = [], [], 0
    while at < len(texts):
        size, last = 0, at
        while last < len(texts) and (last == at or size + len(texts[last]) <= SLICE_BYTES):
            size += len(texts[last])
            last += 1
        hashes, n = hasher(texts[at:last])
        parts.append(np.insert(hashes, np.cumsum(n), END))
        counts.append(n + 1)
        at = last
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(counts)


def pairs(words: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it; the end mark comes before a text."""
    before = np.r_[END, words[:-1]] if len(words) else words
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + words * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7))


def squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising keys as steps, which compress better, and their counts."""
    return pack_columns(np.diff(keys, prepend=np.uint64(0)), counts.astype(np.uint32))


def unsqueeze(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpack_columns(data, "u8", "u4")
    return np.cumsum(steps, dtype=np.uint64), counts


def owners_of(keys: np.ndarray, owners: int) -> np.ndarray:
    """Rising with the key, so that the keys of one owner lie together."""
    return (((keys >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


def _blocks(docs: DataFrame, fold: Column) -> DataFrame:
    """Documents packed by fold: block, fold, doc_ids, lengths, n_bytes, compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        shrink = zstandard.ZstdCompressor(level=1)
        hold: dict[int, list] = {}
        size: dict[int, int] = {}
        number = TaskContext.get().partitionId() << 32

        def packed(fold: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, texts = zip(*hold.pop(fold))
            size.pop(fold)
            row = {
                "block": number,
                "fold": fold,
                "doc_ids": list(ids),
                "lengths": [len(t) for t in texts],
                "n_bytes": sum(map(len, texts)),
                "texts": shrink.compress(b"".join(texts)),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in tidy(batches):
            for part in slices(batch, SLICE_BYTES):
                ids, folds = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "fold"))
                for key, own, text in zip(ids, folds, texts_of(part)):
                    raw = text.encode()
                    if size.get(own, 0) and size[own] + len(raw) > BLOCK_BYTES:
                        yield packed(own)
                    hold.setdefault(own, []).append((key, raw))
                    size[own] = size.get(own, 0) + len(raw)
        for own in list(hold):
            yield packed(own)

    schema = pa.schema(
        [
            ("block", pa.int64()),
            ("fold", pa.int32()),
            ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())),
            ("n_bytes", pa.int64()),
            ("texts", pa.binary()),
        ]
    )
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(fold, F.lit(0)).cast("int").alias("fold"))
    return rows.mapInArrow(
        run, "block long, fold int, doc_ids array<long>, lengths array<long>, n_bytes long, texts binary"
    )


def _unpacked(row: dict) -> list[str]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(row["texts"], max(1, row["n_bytes"]))
    ends = np.cumsum(row["lengths"]).tolist()
    return [data[a:b].decode() for a, b in zip([0, *ends], ends)]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _requests(blocks: DataFrame, owners: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(ascii_words=True)
        for batch in tidy(batches):
            for row in _rows(batch):
                words, _ = tokens(_unpacked(row), hasher)
                sent = []
                for order, keys in ((1, words), (2, pairs(words))):
                    some, counts = np.unique(keys, return_counts=True)
                    cuts = np.flatnonzero(np.diff(owners_of(some, owners))) + 1
                    for own, times in zip(np.split(some, cuts), np.split(counts, cuts)):
                        owner = int(owners_of(own[:1], owners)[0])
                        sent.append((owner, row["block"], row["fold"], order, squeeze(own, times)))
                names = ["owner", "block", "fold", "ngram", "keys"]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sent), kinds)], names)

    return blocks.select("block", "fold", "lengths", "n_bytes", "texts").mapInArrow(
        run, "owner int, block long, fold int, ngram int, keys binary"
    )


def _answers(requests: DataFrame) -> DataFrame:
    """Totals of each request's keys, in its order; with block -1 an owner's words and tokens.

    Totals are those of folds 1 and 2; blocks of fold 1 get those of fold 2 alone as well.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = {c: group.column(c).to_pylist() for c in ("owner", "block", "fold", "ngram")}
        out = []
        for order in (1, 2):
            mine = [i for i, o in enumerate(column["ngram"]) if o == order]
            if not mine:
                continue
            got = [unsqueeze(group.column("keys")[i].as_py()) for i in mine]
            keys = [k for k, _ in got]
            folds = np.repeat([column["fold"][i] for i in mine], [len(k) for k in keys])
            _, place = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.concatenate([c for _, c in got]).astype(np.int64)
            total = np.bincount(place, times * (folds > 0)).astype(np.uint32)
            rest = np.bincount(place, times * (folds == 2)).astype(np.uint32)
            at = 0
            for i, own in zip(mine, keys):
                where = place[at : at + len(own)]
                at += len(own)
                fold = column["fold"][i]
                answer = pack_columns(total[where], rest[where]) if fold == 1 else pack_columns(total[where])
                out.append((column["block"][i], fold, column["owner"][i], order, answer))
            if order == 1:
                sums = [(c > 0).sum() for c in (total, rest)] + [c.sum(dtype=np.int64) for c in (total, rest)]
                out.append((-1, -1, column["owner"][mine[0]], 1, np.array(sums, np.int64).tobytes()))
        names = ["block", "fold", "owner", "ngram", "counts"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return requests.groupBy("owner").applyInArrow(run, "block long, fold int, owner int, ngram int, counts binary")


class Sizes:
    """Distinct words and tokens of the training texts, and of fold 2 alone."""

    def __init__(self, answers: DataFrame):
        stats = answers.where("block = -1").select("counts")
        total = np.zeros(4, np.int64)
        for row in stats.toLocalIterator():  # a row an owner
            total += np.frombuffer(row["counts"], np.int64)
        self.words, self.words_rest, self.tokens, self.tokens_rest = (int(x) for x in total)


def _answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with the answers of all owners, in their order."""
    parts = answers.where("block >= 0").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("ngram", "owner", "counts"))).alias("answers")
    )
    return blocks.join(parts, "block")


def _counts(row: dict, rest: bool, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: count of its pair, of its context, of itself; last, tokens by text."""
    words, sizes = tokens(_unpacked(row), hasher)
    found = []
    for order, keys in ((1, words), (2, pairs(words))):
        kinds = ("u4", "u4") if row["fold"] == 1 else ("u4",)
        got = [unpack_columns(a["counts"], *kinds)[int(rest)] for a in row["answers"] if a["ngram"] == order]
        _, place = np.unique(keys, return_inverse=True)
        found.append(np.concatenate(got).astype(np.int64)[place])
    own, both = found
    ends = np.flatnonzero(words == END)
    before = np.r_[own[ends[0]] if len(ends) else 0, own[:-1]]
    return both, before, own, sizes


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def _step(frequency: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(frequency > 0, np.round(np.log2(frequency) * STEPS), NONE).astype(np.int64)


def learn(answered: DataFrame, sizes: Sizes) -> np.ndarray:
    """Weights by bucket (rows) of pair, word and even share, from blocks of fold 1."""
    rest = max(1, sizes.tokens_rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(ascii_words=True)
        for batch in tidy(batches):
            for row in _rows(batch):
                both, before, own, _ = _counts(row, True, hasher)
                cells = np.stack([bucket(before), _step(both / np.maximum(before, 1)), _step(own / rest)])
                some, times = np.unique(cells, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in some), pa.array(times)], ["b", "p", "w", "n"])

    cells = answered.mapInArrow(run, "b long, p long, w long, n long")
    table = cells.groupBy("b", "p", "w").agg(F.sum("n").alias("n")).toPandas()
    weights = np.tile(np.array(FIXED), (BUCKETS, 1))
    even = 1 / (sizes.words_rest + 1)
    for b, part in table.groupby("b"):
        steps = part[["p", "w"]].to_numpy()
        chance = np.where(steps > NONE, 2.0 ** (steps / STEPS), 0.0)
        chance = np.c_[chance, np.full(len(chance), even)]
        times = part["n"].to_numpy()
        own = weights[int(b)]
        for _ in range(ROUNDS):
            share = chance * own
            share /= share.sum(axis=1, keepdims=True)
            own = (share * times[:, None]).sum(axis=0) / times.sum()
        weights[int(b)] = 0.999 * own + 0.001 / 3  # no estimate is ruled out
    return weights


def _scored(answered: DataFrame, sizes: Sizes, weights: np.ndarray) -> DataFrame:
    n, v = sizes.tokens, sizes.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(ascii_words=True)
        for batch in tidy(batches):
            for row in _rows(batch):
                both, before, own, counts = _counts(row, False, hasher)
                firsts = np.r_[0, np.cumsum(counts)][:-1]
                base = np.log10((own + 0.5) / (n + 0.5 * (v + 1)))
                mix = weights[bucket(before)]
                # Where the context is unknown, the share of the pairs goes to the others.
                seen = before > 0
                chance = mix[:, 0] * both / np.maximum(before, 1) + mix[:, 1] * own / max(1, n) + mix[:, 2] / (v + 1)
                scale = np.where(seen, 1.0, mix[:, 1] + mix[:, 2]) if n else mix[:, 2]
                model = np.log10(chance / scale)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(np.full(len(counts), row["fold"], np.int32)),
                        pa.array(counts),
                        pa.array(np.add.reduceat((own > 0).astype(np.int64), firsts)),
                        pa.array(np.full(len(counts), n, np.int64)),
                        pa.array(np.add.reduceat(base, firsts)),
                        pa.array(np.add.reduceat(model, firsts)),
                    ],
                    ["doc_id", "fold", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return answered.mapInArrow(
        run,
        "doc_id long, fold int, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def score(docs: DataFrame, fold: Column) -> DataFrame:
    """doc_id, fold, n_tokens, n_known, train_tokens, base_score, score of each document.

    ``fold``: 2 counts, 1 counts too and tunes the weights, 0 teaches nothing.
    """
    blocks = bucketed(_blocks(docs, fold), "lm-blocks", "block", ["fold"])
    size = blocks.agg(F.sum("n_bytes")).collect()[0][0] or 0
    owners = max(8, -(-size // (3 * OWNER_KEYS)))  # a word and its pair for every six bytes
    answers = materialize(_answers(_requests(blocks, int(owners))), "lm-answers")
    sizes = Sizes(answers)
    tuned = learn(_answered(blocks.where("fold = 1"), answers.where("fold = 1")), sizes)
    return _scored(_answered(blocks, answers), sizes, tuned)
