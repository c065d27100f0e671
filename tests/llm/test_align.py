import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from quire.llm import align
from tokenizers import Tokenizer

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    a_side = Tokenizer.from_file(A_FILE)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    letters = {letter: byte for byte, letter in align.byte_letters().items()}

    def a_bytes(i):
        return bytes(letters[c] for c in a_side.id_to_token(i))

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    def run(text):
        """Ids of both sides, groups as text, linked places, from whole texts and all pairs."""
        if not text:
            return [], [], "", []
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        want = (" " + text).encode()
        parts = [[a_bytes(i) for i in a], [b_bytes(i) for i in b]]
        if any(b"".join(p) != want for p in parts):
            return [], [], "", []
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        groups, start = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            inside = [",".join(str(i) for i, e in zip(ids, own) if start < e <= cut) for ids, own in zip((a, b), ends)]
            groups.append("|".join(inside))
            start = cut
        starts = [[0, *e[:-1]] for e in ends]
        links = [
            (i, j)
            for i in range(len(a))
            for j in range(len(b))
            if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])
        ]
        return a, b, ";".join(groups), links

    return run


@pytest.fixture(scope="module")
def pieces():
    return align.Pieces(A_FILE, B_FILE)


POOL = [
    "'s", "'", "ll", " ", " ", "  ", "\n", "\t", "A", "b", "é", "中文", "\U0001f600", "1", "23", "!", "--", "<|endoftext|>",
    "<s>", "▁", "　", "\x85", "the", "ing", "aaaa", "don't", "\x00", "\x1c", "᠎", "\xa0", "<0x41>", "hello world",
]


@pytest.mark.parametrize("seed", range(3))
def test_groups_and_links(brute, pieces, seed):
    rng = random.Random(seed)
    texts = ["", " ", "a ", "▁"] + ["".join(rng.choices(POOL, k=rng.randrange(1, 30))) for _ in range(250)]
    found = align.Aligned(pieces, texts)
    described = list(found.described(align.decimal_digits(max(pieces.a_size, pieces.b_size))))
    bounds = np.r_[0, np.cumsum(found.n_links)]
    cuts = [np.split(found.cuts(s), np.cumsum(found.n_groups)[:-1]) for s in (0, 1)]
    for k, text in enumerate(texts):
        a, b, groups, links = brute(text)
        own = [found.links[s][bounds[k] : bounds[k + 1]] - found.first[s][k] for s in (0, 1)]
        assert described[k].decode() == groups, repr(text)
        assert list(zip(*(o.tolist() for o in own))) == links
        assert [int(c[k]) for c in found.counts] == [len(a), len(b)]
        assert found.n_groups[k] == (groups.count(";") + 1 if groups else 0)
        if groups:
            assert cuts[0][k][-1] == len(a) and cuts[1][k][-1] == len(b)


def test_gallop_finds_places():
    rng = np.random.default_rng(1)
    for n, m in [(0, 5), (1, 1), (1, 900), (7, 8), (300, 5000), (1000, 1001)]:
        long = np.cumsum(rng.integers(1, 9, m))
        short = np.unique(np.append(rng.choice(np.arange(1, long[-1] + 1), max(n, 1) - 1, replace=n > long[-1]), long[-1]))[:n]
        assert align.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def plain_report(brute, rows):
    """The report from all links of all documents."""
    made = [(i, brute(t)) for i, t in rows]
    docs = Counter()
    for _, (a, b, _, links) in made:
        docs.update({(a[i], b[j]) for i, j in links})
    most = Counter()
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for i, (a, b, groups, links) in made:
        counts = [(docs[a[x], b[y]], most[a[x]]) for x, y in links]
        hashed = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        n_groups = groups.count(";") + 1 if groups else 0
        out.append((i, len(a), len(b), n_groups, len(links), sum(c == m for c, m in counts), sum(c for c, _ in counts), hashed))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 300, 1 << 20])
def test_report_counts_documents(spark, table, brute, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK_BYTES", block)
    monkeypatch.setattr(align, "BATCH_BYTES", min(block, 1 << 19))
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices(POOL, k=rng.randrange(0, 25)))) for i in range(60)]
    rows += [(70, "hello the world"), (71, "hello the world"), (71, "hello the world"), (None, "the end"), (72, None)]
    got = align.report(table(rows).repartition(3), A_FILE, B_FILE)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_report(brute, rows)


def test_edges(edges, empty, brute):
    rows = [(r.doc_id, r.text) for r in edges.collect() if len(r.text or "") < 1000]
    short = edges.where("length(coalesce(text, '')) < 1000")
    got = [tuple(r) for r in align.report(short, A_FILE, B_FILE).collect()]
    assert sorted(got, key=str) == plain_report(brute, rows)
    whole = {r.doc_id: r for r in align.align(edges, A_FILE, B_FILE).collect()}
    assert len(whole[7].a_ids) >= 40_000 and whole[7].a_cuts[-1] == len(whole[7].a_ids)
    assert whole[8].b_cuts[-1] == len(whole[8].b_ids) and whole[1].link_a == []
    assert align.report(empty, A_FILE, B_FILE).count() == 0
    assert align.align(empty, A_FILE, B_FILE).count() == 0


def test_query(spark, brute):
    from quire.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op12_alignment(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        if len(text or "") < 1500:
            a, b, groups, links = brute(text)
            r = got[i]
            assert (r.n_a, r.n_b, r.n_links) == (len(a), len(b), len(links))
            assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_pieces_may_be_dropped_and_met_again(pieces, monkeypatch):
    fresh = align.Pieces(A_FILE, B_FILE)
    monkeypatch.setattr(align, "CACHE_PIECES", 8)
    rng = random.Random(4)
    for _ in range(12):
        texts = [" ".join(rng.choices(["the", "and", "one,", "x▁y", "zeta", "Ωmega"], k=6)) + f" {rng.random()}" for _ in range(3)]
        want, got = pieces(texts), fresh(texts)
        for side in (0, 1):
            assert got[0][side].tolist() == want[0][side].tolist() and got[1][side].tolist() == want[1][side].tolist()
        assert len(fresh.known) == len(fresh.right) == len(fresh.uses) == len(fresh.ends[0]) - 1


def test_pieces_end_where_they_may():
    import re

    ends, letters = ",.;:!?|\n", align._LATIN
    pattern = align.piece_pattern(ends)
    cut = re.compile(rf"(?<=[^\s᠎])(?= .)|(?<=[{letters}])(?=[{re.escape(ends)}])", re.S)
    rng = random.Random(2)
    pool = list("abé, .\n|;1²'\t　᠎!?-") + ["  ", "word", " word", ", "]
    for _ in range(3000):
        text = " " + "".join(rng.choices(pool, k=rng.randrange(1, 25)))
        assert pattern.findall(text) == cut.split(text)
