import random

import numpy as np
import public_tokenizers
import pytest
from quire.llm import wordbpe
from tokenizers import Tokenizer

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def merges():
    return wordbpe.Merges(FILE)


@pytest.fixture(scope="module")
def encoder():
    return wordbpe.Encoder(FILE)


def split_ids(encoder, texts):
    ids, counts = encoder(texts)
    assert counts.sum() == len(ids)
    return [own.tolist() for own in np.split(ids, np.cumsum(counts)[:-1])]


POOL = [
    "'s", "'re", "'", "'LL", "ll", " ", "  ", "\n", "\t", "A", "b", "Σ", "σ", "İ", "ß", "é", "é", "Å", "中文",
    "\U0001f600", "1", "23", "½", "²", "!", "?", "--", "<|endoftext|>", "<|startoftext|>", "<|", "▁", "​", "　",
    "\x85", "ǅ", "the", "ing", "aaaa", "xx", "don't", "ͅ", "ᾳ", "ẞ", "ﬁ", "_", "\x00", "Ⅷ", "٣", "\x1c", "가",
]


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_those_of_the_library(library, encoder, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(POOL, k=rng.randrange(1, 40))) for _ in range(700)]
    any_point = lambda: chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(32, 127)]))
    texts += ["".join(any_point() for _ in range(30)) for _ in range(300)]
    for text, own in zip(texts, split_ids(encoder, texts)):
        assert own == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("side_by_side", [0, 5, 64])
def test_words_side_by_side_and_alone(library, merges, monkeypatch, side_by_side):
    monkeypatch.setattr(wordbpe, "SIDE_BY_SIDE", side_by_side)
    rng = random.Random(side_by_side)
    words = ["".join(rng.choices("abcdeth", k=rng.randrange(1, 90))) for _ in range(300)]
    words += ["a" * n for n in range(1, 70)] + ["thethe" * 300, "ab" * 1000, "x" * 2001]
    ids, counts = merges.encode([w.encode() for w in words])
    for word, own in zip(words, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == library.encode(word, add_special_tokens=False).ids


def merged(merges, symbols):
    """Plain merging of tokens: the pair of lowest rank, the leftmost of equals, until none is left."""
    ranks = dict(zip(merges.pair_keys.tolist(), merges.pair_ranks.tolist()))
    made = np.argsort(merges.rank, kind="stable")[-int((merges.rank >= 0).sum()) :]
    tokens = list(symbols)
    while True:
        found = [(ranks.get(a * merges.size + b, wordbpe._NEVER), i) for i, (a, b) in enumerate(zip(tokens, tokens[1:]))]
        rank, i = min(found, default=(wordbpe._NEVER, 0))
        if rank == wordbpe._NEVER:
            return tokens
        tokens[i : i + 2] = [int(made[rank])]


def test_pair_test_is_what_merging_does(merges):
    def symbols(token):
        if merges.rank[token] < 0:
            return [token]
        return symbols(int(merges.left[token])) + symbols(int(merges.right[token]))

    rng = np.random.default_rng(5)
    valid = np.unique(merges.token[1:][merges.token[1:] >= 0])
    # Early tokens meet more often in a merge.
    some = valid[rng.integers(0, 1500, (1500, 2))]
    got = merges.compatible(some[:, 0], some[:, 1])
    for (a, b), fits in zip(some.tolist(), got.tolist()):
        assert (merged(merges, symbols(a) + symbols(b)) == [a, b]) == fits
    assert 0 < got.sum() < len(got)


def test_cache_may_be_dropped(library, monkeypatch):
    monkeypatch.setattr(wordbpe, "CACHE_WORDS", 3)
    encoder = wordbpe.Encoder(FILE)
    for k in range(5):
        texts = [f"one two three {k} four", "five one", ""]
        assert split_ids(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="word"):
        wordbpe.Merges(public_tokenizers.path("byte_bpe_50k.json"))


def test_edges(edges, empty, library):
    rows = [r.asDict() for r in edges.collect()]
    want = sorted(str((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows)
    encoded = wordbpe.encode(edges, FILE)
    assert sorted(str((r.doc_id, r.ids)) for r in encoded.collect()) == want
    assert set(encoded.columns) == set(edges.columns)
    back = wordbpe.decode(encoded, FILE).collect()
    assert sorted(str(r.decoded) for r in back) == sorted(
        str(library.decode(library.encode(r["text"] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in rows
    )
    assert wordbpe.digests(empty, FILE).count() == 0
    assert wordbpe.encode(empty, FILE).count() == 0


def test_query(spark, library):
    import hashlib

    from quire.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op11_word_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
