from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from quire.llm import language

LETTERS = language.letter_table(language.letter_runs())


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found = Counter()
    for word in words:
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram != " " and not (n == 3 and gram[1] == " "):
                    found[gram] += 1
    return found


def pack(gram):
    points = [ord(c) for c in gram] + [0] * (3 - len(gram))
    return points[0] << 42 | points[1] << 21 | points[2]


def test_counts_match_a_plain_count():
    texts = ["Der Tag, der war gut.", "", "élan vital 12 x", "a", "中文 mixed ß"]
    owners, packed, counts = language.gram_counts(texts, LETTERS)
    for i, text in enumerate(texts):
        mine = owners == i
        got = dict(zip(packed[mine].tolist(), counts[mine].tolist()))
        assert got == {pack(g): n for g, n in grams(text).items()}


def test_distance_matches_a_plain_one():
    texts = {"de": "der und die das ist nicht mit sich auf ein " * 3, "en": "the of and to in is that it was for " * 3}
    ranked = {k: sorted(grams(t).items(), key=lambda x: (-x[1], pack(x[0])))[: language.PROFILE] for k, t in texts.items()}
    known = {k: np.array([pack(g) for g, _ in r], np.uint64) for k, r in ranked.items()}
    text = "the und that ist for mit whatever"
    own = sorted(grams(text).items(), key=lambda x: (-x[1], pack(x[0])))[: language.PROFILE]
    far = {}
    for k, rows in ranked.items():
        place = {g: i for i, (g, _) in enumerate(rows)}
        far[k] = sum(abs(place[g] - i) if g in place else language.PROFILE for i, (g, _) in enumerate(own))
    best = min(sorted(far), key=far.get)
    names, scores = language.Identifier(known, LETTERS)([text])
    assert names == [best] and abs(scores[0] - (1 - far[best] / (len(own) * language.PROFILE))) < 1e-12


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = language.profiles(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    assert sorted(known) == ["de", "en", "es", "fr"]
    rows = language.identify(docs.select("doc_id", "text", "lang"), known).where("crc32(cast(doc_id as string)) % 4 = 2")
    right = [r.lang_pred == r.lang for r in rows.collect()]
    assert sum(right) > 0.98 * len(right)


def test_edges(spark, edges, empty):
    docs = spark.createDataFrame([("hello there world", "en"), ("bonjour le monde", "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    known = language.profiles(docs, F.lit(True))
    rows = {(r.doc_id, r.text): r for r in language.identify(edges, known).collect()}
    for r in rows.values():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language.identify(empty, known).count() == 0
    none = language.profiles(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(edges, none).collect()} == {"und"}
