import random

import numpy as np
import pytest
from quire.llm import repeats

from .conftest import EDGES


def brute(rows):
    """doc_id, bytes, removed spans and kept bytes by definition; rows in order."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - repeats.LENGTH + 1):
            window = data[p : p + repeats.LENGTH]
            if window in seen:
                gone[p : p + repeats.LENGTH] = True
            seen.add(window)
        edge = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((i, len(data), list(zip(edge[::2], edge[1::2])), kept))
    return out


def found(frame):
    rows = frame.collect()
    return [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows]


def corpus(seed, docs=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(15, 80))) for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            if rng.random() < 0.5:  # another part of it, or with a byte changed
                at = rng.randrange(len(passage))
                passage = passage[at:] if rng.random() < 0.5 else passage[:at] + "#" + passage[at + 1 :]
            parts.append(passage * rng.choice([1, 1, 2]))
            parts.append(word())
        if rng.random() < 0.15:
            parts.append("tior, " * rng.randint(10, 60))
        rows.append((i * 3 + 1, "".join(parts)))
    return rows


@pytest.mark.parametrize("batches", [1, 2, 5, 8])
def test_matches_the_definition(table, batches):
    rows = corpus(batches)
    got = found(repeats.remove_repeats(table(rows).repartition(3), batches))
    assert sorted(got) == brute(rows)


def test_segments_of_a_long_text(table, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 500)
    monkeypatch.setattr(repeats, "COMPARED", 1000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 500)
    long = "".join(t for _, t in corpus(9, 12))
    rows = [(1, long), (2, "x" + long[300:2500] + "y"), (3, "z" * 2000), (4, long)]
    assert sorted(found(repeats.remove_repeats(table(rows), 3))) == brute(rows)


def test_equal_sized_levels_merge(table, monkeypatch):
    sizes = []
    add = repeats.Family.add
    monkeypatch.setattr(repeats.Family, "add", lambda self, r: (add(self, r), sizes.append([n for n, _ in self.levels]))[0])
    rows = corpus(3, 40)
    got = found(repeats.remove_repeats(table(rows), 4))
    assert sorted(got) == brute(rows)
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1]]


def test_edges(table, empty):
    rows = [r for r in EDGES if r[0] != 5]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got = found(repeats.remove_repeats(table(rows)))
    assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0)) == brute(rows)
    twice = table([(5, "a text of its own, " * 20)] * 2)
    got = sorted(found(repeats.remove_repeats(twice)), key=lambda r: len(r[3]))
    assert [len(r[3]) for r in got] == [0, len(brute([(5, "a text of its own, " * 20)])[0][3])]
    assert repeats.remove_repeats(empty).count() == 0


def test_hot_grams_are_dealt_by_window(table, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 10)
    monkeypatch.setattr(repeats, "HOT_IN_BLOCK", 2)
    monkeypatch.setattr(repeats, "HOT_SHARD", 200)
    rng = random.Random(4)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = "the line of forty bytes that all texts have"
    rows = [(i, own(120) + line + own(120)) for i in range(60)]
    rows += [(60 + i, rows[i][1][60:250] + own(9)) for i in range(0, 30, 2)] + [(100 + i, text) for i, text in corpus(6, 30)]
    hot, n = [], repeats._hot
    monkeypatch.setattr(repeats, "_hot", lambda *a: (hot.append(n(*a)), hot[-1])[1])
    assert sorted(found(repeats.remove_repeats(table(rows).repartition(2), 3))) == brute(rows)
    assert len(hot[0][0]) and hot[0][1] >= 60
    again = found(repeats.remove_repeats(table(rows).repartition(2), 1))
    assert sorted(again) == brute(rows)


def test_equal_entries_of_a_block_are_sent_once(table):
    rows = [(i, "one and the same passage of over a hundred bytes that every text of the block holds, word for word, no change") for i in range(50)]
    blocks = repeats._blocks(table(rows).coalesce(1).selectExpr("doc_id", "text", "0 as batch"))
    sent = repeats._requests(blocks, 8, np.zeros(0, np.uint64)).collect()
    grams = np.concatenate([repeats.unpack_columns(r.entries, *repeats._ENTRY)[0] for r in sent])
    assert len(grams) == len(set(grams.tolist())) < 20
    assert sorted(found(repeats.remove_repeats(table(rows)))) == brute(rows)
