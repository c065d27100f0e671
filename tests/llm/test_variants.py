import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from quire.llm import queries, variants

LOWER = str.maketrans(variants.UPPER, variants.LOWER)


def brute(rows, shortest=5, least=3, ratio=2, part=None):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if part and h % part == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= shortest
    words = {w: c for w, c in n.items() if c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    nears = {w: [u for u in words if near(w, u)] for w in words}
    form = {}
    for w in words:
        best = min(nears[w], key=lambda u: (-words[u], u), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(nears[w]), words.get(form[w])))
    return out


def found(df, **parameters):
    rows = [tuple(r) for r in variants.variants(df, **parameters).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("part", [None, 7])
@pytest.mark.parametrize("letters", ["ab", "abÀÿ", "abcdefgh"])
def test_all_near_words(table, part, letters):
    rng = random.Random(len(letters))
    rows = [(i, " ".join("".join(rng.choices(letters, k=rng.randrange(4, 8))) for _ in range(60)) + " ABAAB 12 abÉ") for i in range(40)]
    assert found(table(rows), part=part) == brute(rows, part=part)


def test_chains_are_followed(table):
    # Each word has twice the count of the one before it and differs from it by one letter.
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbc"]
    rows = [(k, " ".join([w] * (3 * 2**k))) for k, w in enumerate(chain)]
    got = {r[0]: r for r in found(table(rows))}
    assert got["aaaaa"][1:3] == ("aaaab", "bbbbbc") and got["bbbbbc"][1:3] == (None, "bbbbbc")
    assert set(got.values()) == brute(rows)


def test_long_words(table):
    base = "abcdefghij" * 6 + "klmn"  # as long as words that go by their text
    words = [
        base, base + "x", base + "xy", base + "xz", base[:30] + "q" + base[30:] + "xy", base[:30] + base[31:] + "xy",
        "ab" * 300, "ab" * 300 + "a", "a" * 100, "a" * 101, "a" * 99 + "b", base[:-1], base[1:],
    ]
    rows = [(i, " ".join(words + [words[i % len(words)]] * 5)) for i in range(6)]
    want = brute(rows)
    assert found(table(rows)) == want
    assert any(len(r[0]) > 100 and r[4] for r in want)


def test_fingerprints_are_of_rotations():
    prime, base = variants._PRIME, variants._BASE

    def plain(text):
        value = 0
        for c in text:
            value = (value * base + ord(c)) % prime
        return value

    word = "abracadabra"
    skips, wholes = variants.fingerprints(word)
    assert skips == [plain(word[i + 1 :] + "$" + word[:i]) for i in range(len(word))]
    assert wholes == [plain(word[i:] + "$" + word[:i]) for i in range(len(word) + 1)]


def test_edges(edges, empty, table):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert found(edges, least=1, part=3) == brute(rows, least=1, part=3)
    assert found(empty) == set()
    # One very long word in several texts takes time in proportion to its length.
    giant = [(i, "x" * 60_000 + " " + "x" * 60_001) for i in range(3)]
    got = {len(r[0]): r for r in found(table(giant))}
    assert got[60_000][4] == got[60_001][4] == 1 and got[60_000][1] is None


def test_query_is_what_sql_gives(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op13_spelling_variants"]).fetchall()
    got = [tuple(r) for r in queries.op13_spelling_variants(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
