import random

import expected
from pyspark.sql import functions as F
from quire.functions import fixed, text as tx
from quire.operators import pages as pg


def values(spark, inputs, column):
    rows = [(i, t) for i, t in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(4)
    return [r[1] for r in sorted(df.select("i", column.alias("v")).collect())]


def random_texts(seed, count, pieces, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randint(0, longest))) for _ in range(count)]


def test_white_space_is_unicode(spark):
    assert len(fixed.WHITE_SPACE) == 25
    inputs = [f"{c}a b{c}" for c in fixed.WHITE_SPACE] + ["\u200ba\u200b", "\ufeffa\ufeff"]
    got = values(spark, inputs, tx.trim_ws(F.col("t")))
    assert got == ["a b"] * 25 + ["\u200ba\u200b", "\ufeffa\ufeff"]
    assert values(spark, ["\ufeff\xa0 x\n\ufeff", "\x85x"], tx.trim_ecma(F.col("t"))) == ["x", "\x85x"]


def test_lines(spark):
    inputs = ["", "a", "a\n", "a\n\n", "a\r\nb\r\n", "a\rb", "\n", "a\r\r\nb", "a\r"]
    got = values(spark, inputs, tx.text_lines(F.col("t")))
    assert got == [[], ["a"], ["a"], ["a", ""], ["a", "b"], ["a\rb"], [""], ["a\r", "b"], ["a\r"]]


def test_cut_bytes_keeps_characters_whole(spark):
    inputs = ["x" * 200, "x" * 201, "ก" * 70, "x" + "ก" * 70, "xx" + "ก" * 70, "é" * 120, "😀" * 60, "x😀" * 60]
    got = values(spark, inputs, tx.cut_bytes(F.col("t"), 200))
    for text, cut in zip(inputs, got):
        assert cut == text.encode()[:200].decode(errors="ignore")
    assert values(spark, ["ab", "a" * 201], tx.preview(F.col("t"))) == ["ab", "a" * 200 + "..."]


def test_cleanup_examples(spark):
    cases = {
        "": "",
        " \n\t\n": "",
        "one\ntwo": "one two",
        "one.\ntwo": "one.\ntwo",
        "one\n\n\n two  words ": "one\n\ntwo words",
        "a\n- b\n* c\n• d\n# e\n> f": "a\n- b\n* c\n• d\n# e\n> f",
        "a\n1. b": "a\n1. b",
        "a\n1 b": "a 1 b",
        "a  b  c\nd": "a  b  c d",
        "ครับ\nก": "ครับ\nก",
        "a\xa0\u3000b\r\nc": "a b c",
        "ๆ\nb": "ๆ\nb",
    }
    got = values(spark, list(cases), tx.cleanup(F.col("t")))
    assert got == list(cases.values())


def test_cleanup_random(spark):
    pieces = ["a", "bc", " ", "  ", "\n", "\n", "\n\n", "\t", "\r\n", ". ", ".", ":", "- ", "# ", "1", "7. ", "\xa0",
              "\u2003", "\u3000", "\u2028", "\x85", "ๆ", "ครับ", "ค่ะ", "ก", "é", "> ", "•", "|"]
    texts = random_texts(1, 8000, pieces, 18)
    assert values(spark, texts, tx.cleanup(F.col("t"))) == [expected.cleanup(t) for t in texts]


def test_table_shape_random(spark):
    pieces = ["a", "b c", " ", "  ", "\t", "\n", "\n", "a b c\n", "d e f g\n", "x  y  z\n", "long line of six words\n"]
    texts = random_texts(2, 6000, pieces, 20)
    got = values(spark, texts, pg.looks_like_table(F.col("t")))
    want = [expected.is_table(t) for t in texts]
    assert got == want
    assert 500 < sum(want) < 5500


def test_literals_are_not_patterns(spark):
    inputs = ["a.b", "axb", "$1 (x) [y] {z} \\Q \\E ^|?*+"]
    assert values(spark, inputs, F.col("t").rlike(tx.literal_pattern("A.B", False))) == [True, False, False]
    pattern = tx.literal_pattern(inputs[2], True)
    assert values(spark, inputs, F.col("t").rlike(pattern)) == [False, False, True]


def test_object_addresses(spark):
    names = ["a.png", "b.jpeg", "c.md", "d.json", "e.bin"]
    got = values(spark, names, tx.mime_type(F.col("t")))
    assert got == ["image/png", "image/jpeg", "text/markdown; charset=utf-8", "application/json; charset=utf-8",
                   "application/octet-stream"]
    assert values(spark, ["x.png"], tx.public_url("http://h/", F.col("t"), "p/")) == ["http://h/p/x.png"]
    assert values(spark, ["x.png"], tx.public_url("http://h", F.col("t"))) == ["http://h/x.png"]
