import re

import numpy as np
import pytest
from quire.llm import decontaminate, lm, neardup
from quire.llm.words import Hasher
from pyspark.sql import functions as F

FLIP = str.maketrans("ab", "ba")


def alternating(n):
    word = "a"
    while len(word) < n:
        word += word.translate(FLIP)
    return word


@pytest.mark.parametrize("ascii_words", [True, False])
def test_words_of_structure_differ(ascii_words):
    # A polynomial modulo a power of two gives an alternating word and its complement one value.
    words = []
    for n in (4, 8, 64, 256, 512, 1024, 4096):
        words += [alternating(n), alternating(n).translate(FLIP)]
    words += ["a" * n for n in range(1, 300)] + ["ab" * n for n in range(1, 200)] + ["b" + "a" * n for n in range(1, 300)]
    words = list(dict.fromkeys(words))
    hashes, counts = Hasher(ascii_words)(words)
    assert counts.tolist() == [1] * len(words) and len(set(hashes.tolist())) == len(words)


def test_equal_words_agree_wherever_they_stand():
    rng = np.random.default_rng(3)
    letters = list("abcé中 \n\tXYZ") + ["\U0001f600"]
    texts = ["".join(rng.choice(letters, 60)) for _ in range(300)] + ["", "z" * 700, "z" * 700 + " z"]
    hashes, counts = Hasher(True)(texts)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))]
    assert len(words) == len(hashes) and counts.sum() == len(words)
    pairs = set(zip(words, hashes.tolist()))
    assert len(pairs) == len(set(words)) == len(set(hashes.tolist()))


def test_operators_tell_such_words_apart(table):
    one, two = alternating(1024), alternating(1024).translate(FLIP)
    rows = [(1, f"{one} {one} {one}"), (2, f"{two} {two} {two}"), (3, "some other words here")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(rows), words=3, percent=85, bands=32, rows=8).collect()}
    assert got == {1: 1, 2: 2, 3: 3}
    parts = F.when(F.col("doc_id") == 2, 0).when(F.col("doc_id") == 3, 1).otherwise(2)
    scored = {r.doc_id: r.n_known for r in lm.score(table(rows, extra=False), parts).collect()}
    assert scored[2] == 1  # the end alone: the word was not seen in training
    words = " ".join(["the", "cat", "sat", one, "on", "a", "mat", "by", "it", "all", "day", "long"])
    items = table([(9, words)], extra=False).select(F.col("doc_id").alias("item_id"), "text")
    found = decontaminate.leaks(table([(1, words), (2, words.replace(one, two))], extra=False), items)
    rows = {r.doc_id: r for r in found.collect()}
    assert 1 in rows
