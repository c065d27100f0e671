import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.llm import lm

from .conftest import EDGES
from .test_neardup import LOWER, WORD

def parts():
    return F.when(F.col("doc_id") % 5 == 1, 0).when(F.col("doc_id") % 5 == 0, 1).otherwise(2)


def words(text):
    return [*WORD.findall((text or "").translate(LOWER)), "</s>"]


def counts(rows, folds):
    one, two = Counter(), Counter()
    for i, text in rows:
        if fold(i) in folds:
            own = words(text)
            one.update(own)
            two.update(zip(["</s>", *own], own))
    return one, two


def fold(i):
    return 2 if i is None else {1: 0, 0: 1}.get(i % 5, 2)


def mixture(one, two, weights, before, word):
    n, v = sum(one.values()), len(one)
    mix = weights[int(lm.bucket(np.array([one[before]]))[0])]
    chance = mix[1] * one[word] / n + mix[2] / (v + 1)
    if one[before]:
        return chance + mix[0] * two[before, word] / one[before]
    return chance / (mix[1] + mix[2])


def corpus():
    text = "the cat sat on the mat and the dog saw the cat near a red house with no door"
    base = text.split()
    rng = np.random.default_rng(2)
    return [(i, " ".join(base[(k + i) % len(base)] for k in rng.integers(0, 9, 30).cumsum())) for i in range(60)] + EDGES[:3]


def test_scores_match_plain_counts(table, monkeypatch):
    weights = np.random.default_rng(1).dirichlet([1, 1, 1], lm.BUCKETS)
    monkeypatch.setattr(lm, "learn", lambda *_: weights)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 400)
    monkeypatch.setattr(lm, "OWNER_KEYS", 20)
    rows = [(i + 100, t) for i, t in corpus()]
    one, two = counts(rows, (1, 2))
    n, v = sum(one.values()), len(one)
    got = {r.doc_id: r for r in lm.score(table(rows).repartition(3), parts()).collect()}
    assert len(got) == len({i for i, _ in rows})
    for i, text in dict(rows).items():
        own, r = words(text), got[i]
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        model = sum(math.log10(mixture(one, two, weights, a, w)) for a, w in zip(["</s>", *own], own))
        if (i, text) == [x for x in rows if x[0] == i][-1] and sum(x[0] == i for x in rows) == 1:
            assert (r.fold, r.n_tokens, r.n_known, r.train_tokens) == (fold(i), len(own), sum(w in one for w in own), n)
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(model)
    for before in ("the", "never seen"):
        total = sum(mixture(one, two, weights, before, w) for w in [*one, "unknown"])
        assert total == pytest.approx(1)


def test_weights_are_learned_on_held_out_counts(table):
    rows = corpus()
    blocks = lm.bucketed(lm._blocks(table(rows), parts()), "t", "block", ["fold"])
    answers = lm.materialize(lm._answers(lm._requests(blocks, 4)), "t")
    sizes = lm.Sizes(answers)
    one, two = counts(rows, (2,))
    assert (sizes.words_rest, sizes.tokens_rest) == (len(one), sum(one.values()))
    tuned = lm.learn(lm._answered(blocks.where("fold = 1"), answers.where("fold = 1")), sizes)
    assert np.allclose(tuned.sum(axis=1), 1) and (tuned > 0).all()

    def likelihood(weights):
        held = [w for i, t in rows if fold(i) == 1 for w in zip(["</s>", *words(t)], words(t))]
        return sum(math.log(mixture(one, two, weights, *pair)) for pair in held)

    best = likelihood(tuned)
    assert best > likelihood(np.tile(lm.FIXED, (lm.BUCKETS, 1))) - 1e-6
    assert best > likelihood(np.tile([0.01, 0.98, 0.01], (lm.BUCKETS, 1)))


def test_edges(edges, empty):
    got = lm.score(edges, parts()).collect()
    assert len(got) == len(EDGES) and all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score(empty, parts()).count() == 0
    untrained = lm.score(edges, F.lit(0)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in untrained} == {(0, 0, 0.0)}
    assert max(abs(r.score) for r in untrained) < 1e-9
    assert all(np.isfinite(r.score) for r in lm.score(edges, F.lit(2)).collect())
