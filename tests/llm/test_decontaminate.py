import random
import re

from quire.llm import decontaminate

from .conftest import EDGES

WORDS = re.compile(r"[^\W_]+")


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def items(rng, n=12):
    return [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(rng.randint(12, 40)))) for i in range(n)]


def test_planted_passages_with_substitutions(spark, table, monkeypatch):
    rng = random.Random(6)
    known = items(rng)
    docs, want = [], set()
    for d in range(80):
        own = [f"d{rng.randrange(5000)}" for _ in range(60)]
        if d % 2:
            i, text = rng.choice(known)
            passage = text.split()
            for k in range(5, len(passage), 10):
                passage[k] = "changed"
            own[20:20] = [w.upper() + "," for w in passage]
            want.add((d, i))
        docs.append((d, " ".join(own)))
    found = decontaminate.leaks(table(docs), bench(spark, known)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    for r in found:
        length = len(dict(known)[r.item_id].split())
        assert r.doc_start - r.item_start == 20 and r.n_words >= length - 4
        assert r.n_matched >= decontaminate.SIMILARITY * r.n_words
    one = sorted(map(tuple, found))
    monkeypatch.setattr(decontaminate, "INDEX_WINDOWS", 300)  # one index after the other
    assert sorted(map(tuple, decontaminate.leaks(table(docs), bench(spark, known)).collect())) == one
    kept = decontaminate.clean(table(docs), bench(spark, known))
    assert sorted(r.doc_id for r in kept.collect()) == [d for d in range(80) if d % 2 == 0]
    assert kept.columns == table(docs).columns


def test_exact_matches_agree_with_a_plain_search(spark, table):
    rng = random.Random(8)
    known = [(i, " ".join(rng.choice("abc") for _ in range(14))) for i in range(25)]
    docs = [(d, " ".join(rng.choice("abc") for _ in range(400))) for d in range(25)]
    n = decontaminate.MIN_MATCHED
    want = set()
    for d, text in docs:
        for i, item in known:
            parts = item.split()
            if any(f" {' '.join(parts[p : p + n])} " in f" {text} " for p in range(len(parts) - n + 1)):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(docs), bench(spark, known)).collect()}
    assert want and want <= got


def test_edges(spark, edges, empty):
    known = bench(spark, [(1, None), (2, ""), (3, "too short"), (None, "the same row twice, word for word"), (4, "SAME row: twice word for word")])
    got = sorted((r.doc_id, r.item_id is None, r.n_matched) for r in decontaminate.leaks(edges, known).collect())
    assert got == [(5, False, 6), (5, False, 6), (5, True, 7), (5, True, 7)]
    assert decontaminate.leaks(edges, known.limit(0)).count() == 0
    assert decontaminate.clean(edges, known.limit(0)).count() == len(EDGES)
    assert decontaminate.leaks(empty, known).count() == 0
    marked = decontaminate.mark(edges, known)
    assert marked.columns == [c for c in edges.columns if c != "leaks"] + ["leaks"]


def plain_best(words, item):
    """The overlap by trying every stretch of every line."""
    best, n = None, len(item)
    wanted = decontaminate.MIN_MATCHED if n >= decontaminate.MIN_MATCHED else 0.8 * n
    for line in range(1 - n, len(words)):
        a, b = max(0, line), min(len(words), line + n)
        same = [words[k] == item[k - line] for k in range(a, b)]
        for i in range(len(same)):
            for j in range(i + 1, len(same) + 1):
                m = sum(same[i:j])
                if same[i] and same[j - 1] and m >= wanted and 5 * m >= 4 * (j - i):
                    found = (a + i, a + i - line, j - i, m)
                    if best is None or (-m, found) < (-best[3], best):
                        best = found
    return best


def test_random_substitutions_agree_with_brute_force(spark, table):
    rng = random.Random(9)
    known = [(i, " ".join(f"w{i}x{k}" for k in range(n))) for i, n in enumerate([8, 10, 10, 11, 12, 15, 15, 20, 20, 25, 30])]
    docs = []
    for d in range(400):
        i, text = rng.choice(known)
        passage = text.split()
        part = passage[rng.randint(0, 2) :]
        for k in rng.sample(range(len(part)), rng.randint(len(part) // 10, -(-len(part) // 5))):
            part[k] = f"changed{rng.randrange(10)}"
        docs.append((d, " ".join(["before"] * rng.randint(0, 6) + part + ["after"] * rng.randint(0, 6))))
    docs += [(1000 + k, " ".join("x" if p == k - 1 else f"w1x{p}" for p in range(10))) for k in (3, 4, 7, 8)]
    want = set()
    for d, text in docs:
        for i, item in known:
            if best := plain_best(text.split(), item.split()):
                want.add((d, i, *best))
    assert {d for d, *_ in want} >= {1003, 1004, 1007, 1008}
    assert set(map(tuple, decontaminate.leaks(table(docs), bench(spark, known)).collect())) == want
