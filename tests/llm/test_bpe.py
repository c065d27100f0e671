import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from quire.llm import bpe

from .conftest import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TABLE = bpe.class_table(bpe.tiktoken_classes())
PAIRS = bpe.mergeable_pairs(RANKS)


def encode(texts, cache=None):
    cache = cache or bpe.PieceCache(bpe.PairMerger(RANKS, PAIRS))
    ids, counts = bpe.encode_texts(texts, TABLE, cache)
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def test_random_texts_match_the_library():
    rng = random.Random(5)
    letters = [*"aab'' 1\n\t  .!sdtmrevll", "é", "中", "　", "\U0001f600", "²", "\x85", "<|endoftext|>"]
    cache = bpe.PieceCache(bpe.PairMerger(RANKS, PAIRS), bits=6)  # slots are contested
    for _ in range(400):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(6)]
        assert encode(texts, cache) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_long_pieces_and_cut_texts(monkeypatch):
    for text in ("ab" * 300, "der " * 4000, "zq" * 40 + " don't we'll", "a" * 65):
        assert encode([text]) == [LIBRARY.encode_ordinary(text)]
    monkeypatch.setattr(bpe.segments, "__defaults__", (50,))
    text = "The quick brown  fox\n jumps; it's over the lazy dog and  more words " * 5
    assert len(bpe.segments([text])[0]) > 3
    assert encode([text, "", text]) == [LIBRARY.encode_ordinary(t) for t in (text, "", text)]


def test_full_pool_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "POOL_IDS", 40)
    cache = bpe.PieceCache(bpe.PairMerger(RANKS, PAIRS))
    for text in ("alpha beta gamma", "delta epsilon zeta eta", "alpha theta" * 9):
        assert encode([text], cache) == [LIBRARY.encode_ordinary(text)]


def test_offsets_give_any_range():
    words = bpe.Vocabulary(RANKS)
    ids = np.array(LIBRARY.encode_ordinary("Größe matters, doesn't it?"))
    ends = np.cumsum(words.lengths[ids])
    assert words.decode(ids, ends).tobytes().decode() == "Größe matters, doesn't it?"
    assert words.decode(ids[3:6], ends[3:6] - ends[2]).tobytes() == LIBRARY.decode_bytes(ids[3:6].tolist())
    with pytest.raises(ValueError):
        words.decode(ids, ends + 1)


def test_edges(edges, empty):
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(edges, PATH).collect())
    want = []
    for _, text in EDGES:
        ids = LIBRARY.encode_ordinary(text or "")
        texts = " ".join(map(str, ids)).encode(), (text or "").encode()
        want.append((len(ids), *(hashlib.sha256(t).hexdigest() for t in texts)))
    assert got == sorted(want)
    encoded = bpe.encode(edges, PATH)
    assert "batch" in encoded.columns and encoded.schema["ids"].dataType.simpleString() == "array<int>"
    assert bpe.digests(empty, PATH).count() == 0
