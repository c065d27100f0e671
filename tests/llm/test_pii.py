import hashlib
import random
import re

from quire.llm import pii

from .conftest import EDGES

FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    ("card", r"[0-9](?:[ -]?[0-9])+"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]"),
]


def luhn(text):
    total = 0
    for i, c in enumerate([int(c) for c in text if c.isdigit()][::-1]):
        total += c if i % 2 == 0 else sum(divmod(2 * c, 10))
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = sum(c.isdigit() for c in m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= digits <= 19 and luhn(m[0]),
                "phone": lambda: 10 <= digits <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{FORMS[rank][0]}:{start}:{end}" for start, rank, end in spans)


def agrees(row, text):
    want = base(text or "")
    assert row.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), text
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(s[1] == k for s in want) for k in range(4))
    assert set(filter(None, joined(want).split(","))) <= set(row.spans.split(","))


def test_base_matches_plain_patterns(table):
    rng = random.Random(3)
    parts = ["1", "2", "25", "4111111111111111", "a@b.c", "@", ".", " ", "-", "+", "(", "_", "é", "\U0001f600", "x",
             "192.168.0.1", "\n", "5", "00", "+1 (555) 123-4567"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    rows += [(2000, "9" * 20_000), (2001, "a." * 8000 + "@x"), (2002, "1.2.3.4 " * 1500), (2003, "a@b.c_x@d.e")]
    got = {r.doc_id: r for r in pii.report(table(rows)).collect()}
    for i, text in rows:
        agrees(got[i], text)


def test_contexts_discover_identifiers(table):
    cards = [f"41111111111{i:04d}" for i in range(3000)]
    good = [c + d for c in cards for d in "0123456789" if luhn(c + d)][:40]
    rows = [(i, f"note {i} please charge card {c} today") for i, c in enumerate(good)]
    odd = "4111111111110001"
    assert not luhn(odd)
    rows += [(100, f"please charge card {odd} today"), (101, f"random {odd[:-1]}7 number"), (102, "order 4 of 9")]
    got = {r.doc_id: r for r in pii.report(table(rows)).collect()}
    for i, text in rows:
        agrees(got[i], text)
    at = rows[40][1].index(odd)
    assert got[100].spans == f"card:{at}:{at + 16}" and got[100].n_card == 0
    assert got[101].spans == "" and got[102].spans == ""


def test_contexts_discover_spaced_numbers(table):
    spaced = lambda n: " ".join(n[k : k + 4] for k in range(0, 16, 4))
    cards = [c + d for c in (f"41111111111{i:04d}" for i in range(400)) for d in "0123456789" if luhn(c + d)][:40]
    rows = [(i, f"note {i} please charge card {spaced(c)} today") for i, c in enumerate(cards)]
    rows += [(100 + i, f"you can call +1 (017) 555-{7000 + i} tomorrow") for i in range(40)]
    odd = "4111 1111 1111 0001"
    assert not luhn(odd)
    new = [(500, f"please charge card {odd} today", "card", odd),
           (501, "you can call 1 (017) 555-7713 tomorrow", "phone", "1 (017) 555-7713"),
           (503, f"random {odd} number", "card", odd),
           (504, "a table 1 (017) 555-7714 of 12 34 56", None, None)]
    got = {r.doc_id: r for r in pii.report(table(rows + [n[:2] for n in new])).collect()}
    for i, text in rows:
        agrees(got[i], text)
    for i, text, kind, value in new:
        at = text.index(value) if kind else 0
        assert got[i].spans == (f"{kind}:{at}:{at + len(value)}" if kind else ""), text
        assert got[i].n_card == got[i].n_phone == 0
    hidden = {r.doc_id: r.text for r in pii.redact(table(rows + [n[:2] for n in new])).collect()}
    assert hidden[500] == "please charge card <CARD> today" and hidden[501] == "you can call <PHONE> tomorrow"


def test_long_tokens_are_mentions(table):
    got = pii.mentions(_found(table([(1, "see " + "1" * 100 + " there")]))).collect()
    assert [(r.start, r.end, r.rank) for r in got] == [(4, 104, -1)]


def _found(frame, context=False):
    from pyspark.sql import functions as F

    return frame.select(F.struct("doc_id").alias("_row"), "text", pii.base_spans(F.col("text"), context).alias("_base"))


def test_redaction(table):
    rows = [(1, "mail a@b.de or call +1 (555) 123-4567!"), (2, "nothing"), (3, None), (4, "é 10.0.0.1")]
    frame = table(rows)
    out = pii.redact(frame)
    assert out.columns == frame.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts == {1: "mail <EMAIL> or call <PHONE>!", 2: "nothing", 3: None, 4: "é <IP>"}


def test_edges(edges, empty):
    rows = pii.report(edges).collect()
    assert len(rows) == len(EDGES) and {r.spans for r in rows} == {""}
    assert pii.report(empty).count() == 0
    repeated = edges.limit(0).select("doc_id", "text")
    twice = repeated.sparkSession.createDataFrame([(5, "x 10.0.0.1"), (5, "x 10.0.0.1"), (5, "other"), (None, "y 10.0.0.2")], repeated.schema)
    got = sorted(r.spans for r in pii.report(twice).collect())
    assert got == ["", "ip:2:10", "ip:2:10", "ip:2:10"]


def test_only_spark_functions(edges):
    plan = pii.report(edges)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


WHITE = " \t\n\x0b\x0c\r"


def plain_mentions(text):
    """Mentions by regular expressions on the whole text: (start, end, rank, left, right)."""
    seeds = base(text)
    found = set()
    for m in re.finditer(rf"(?<![^{WHITE}])[^{WHITE}]+", text):
        if re.search("[0-9@]", m[0]):
            core = re.search(r"[0-9A-Za-z@+](?:.*[0-9A-Za-z])?", m[0])
            if "@" in m[0] and core is None:
                continue
            value = core[0]
            if sum(c in "0123456789" for c in value) >= 4 or "@" in value:
                found.add((m.start() + core.start(), m.start() + core.end()))
    if re.search(r"[0-9][).-]* ", text):
        for form in (FORMS[2][1], r"\+?[0-9][ ().0-9-]+[0-9]"):
            for m in re.finditer(form, text):
                if " " in m[0] and sum(c.isdigit() for c in m[0]) >= 4:
                    found.add(m.span())
    free = [(a, b, -1) for a, b in found if not any(s < b and a < e for s, _, e in seeds)]
    out = []
    for a, b, rank in sorted(free + [(s, e, r) for s, r, e in seeds]):
        left = re.search(rf"([^{WHITE}]+)[{WHITE}]+\Z", text[:a])
        right = re.match(rf"[{WHITE}]+([^{WHITE}]+)", text[b:])
        out.append((a, b, rank, left[1].lower() if left else "", right[1].lower() if right else ""))
    return out


def test_mentions_match_plain_search(spark):
    rng = random.Random(8)
    parts = ["1234", "12 34 56", "4111111111111111", "a@b.c", "(", ")", ".", " ", "  ", "\n", "+1 (555) 123-4567", "word", "x" * 60,
             " " * 50, "10.0.0.1", ",", "é", "id=99887", "Card", "-", "77 88 99 00"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))) for i in range(400)]
    frame = _found(spark.createDataFrame(rows, "doc_id long, text string"), context=True)
    got = {}
    for r in pii.mentions(frame).collect():
        sides = {p.split("\t")[0]: p.split("\t") for p in r.patterns}
        left = sides["l"][1] if "l" in sides else ""
        right = sides["r"][1] if "r" in sides else ""
        got.setdefault(r._row.doc_id, []).append((r.start, r.end, r.rank, left, right))
    for i, text in rows:
        assert sorted(got.get(i, [])) == sorted(plain_mentions(text)), repr(text)


def plain_bootstrap(rows):
    """The graph's scores by loops: {instance: rank} of what is accepted or a seed."""
    edges = {(r.instance, p) for r in rows for p in r.patterns}
    sizes = {}
    for _, p in edges:
        sizes[p] = sizes.get(p, 0) + 1
    seeds = {}
    for r in rows:
        if r.rank >= 0:
            seeds[r.instance] = min(seeds.get(r.instance, 9), r.rank)
    scores = {(i, k): 1.0 for i, k in seeds.items()}
    for _ in range(pii.ROUNDS):
        totals = {}
        for i, p in edges:
            for (j, k), s in scores.items():
                if i == j:
                    totals.setdefault((p, k), []).append(s)
        sure = {k: sum(v) / (sizes[k[0]] + 1) for k, v in totals.items() if len(v) >= pii.SUPPORT}
        sure = {k: v for k, v in sure.items() if v >= pii.PATTERN_CONFIDENCE}
        scores = {(i, k): 1.0 for i, k in seeds.items()}
        for i, p in edges:
            for (q, k), c in sure.items():
                if p == q and i not in seeds:
                    scores[i, k] = 1 - (1 - scores.get((i, k), 0.0)) * (1 - c)
    best = {}
    for (i, k), s in scores.items():
        if s >= pii.ACCEPT and (i not in best or (s, -k) > best[i]):
            best[i] = (s, -k)
    return {i: -k for i, (_, k) in best.items()}


def test_pattern_graph_matches_plain_loops(spark):
    rng = random.Random(6)
    rows = []
    for i in range(500):
        word = rng.choice(["call", "ip", "card", "mail", "room"])
        value = {"call": f"+1 (555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}", "ip": f"10.0.{rng.randrange(9)}.{rng.randrange(300)}",
                 "card": f"411111111111{rng.randrange(1000, 1040)}", "mail": f"u{rng.randrange(40)}@b.{rng.choice(['c', ''])}",
                 "room": f"{rng.randrange(1000, 1030)}"}[word]
        rows.append((i, f"{rng.choice(['please', 'now'])} {word} {value} {rng.choice(['today', 'soon'])}"))
    mentioned = pii.mentions(_found(spark.createDataFrame(rows, "doc_id long, text string"), context=True))
    want = plain_bootstrap(mentioned.collect())
    got = {r.instance: r["rank"] for r in pii.bootstrap(mentioned).collect()}
    assert got == want
    seeds = {r.instance for r in mentioned.collect() if r["rank"] >= 0}
    assert set(got) - seeds  # something was discovered


def test_running_values(spark):
    from itertools import accumulate

    rng = random.Random(1)
    rows = [[rng.randrange(-50, 50) for _ in range(n)] for n in (0, 1, 2, 255, 256, 257, 700)]
    frame = spark.createDataFrame([(r,) for r in rows], "v array<int>")
    from pyspark.sql import functions as F

    got = frame.select(pii.prefixes(F.col("v"), pii._sum).alias("s"), pii.prefixes(F.col("v"), pii._largest).alias("m")).collect()
    assert [r.s for r in got] == [list(accumulate(v)) for v in rows]
    assert [r.m for r in got] == [list(accumulate(v, max)) for v in rows]


def test_a_text_of_very_many_numbers(table):
    import time

    def seconds(n):
        numbers = [f"{k * 7919 % 1_000_000:06d}" for k in range(n)]
        start = time.time()
        [row] = pii.report(table([(1, " ".join(numbers) + " 10.0.0.1")], extra=False)).collect()
        assert row.n_ip == 1 and row.spans.endswith(f"ip:{7 * n}:{7 * n + 8}")
        return time.time() - start

    seconds(1000)
    few, many = seconds(10_000), seconds(100_000)
    assert many < 10 * few + 10
    text = " ".join(f"10.0.{k % 200}.{k % 250} x" for k in range(20_000))
    [hidden] = pii.redact(table([(1, text)], extra=False)).collect()
    assert hidden.text == " ".join(["<IP> x"] * 20_000)
