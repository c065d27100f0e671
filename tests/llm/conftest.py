import pytest


@pytest.fixture
def table(spark):
    """Documents from ``[(doc_id, text), ...]``, with columns that clash with the operators' own."""

    def make(rows, extra=True):
        made = spark.createDataFrame(rows, "doc_id long, text string")
        if not extra:
            return made
        from pyspark.sql import functions as F

        return made.selectExpr(
            "*", "'x' as score", "1 as ids", "'y' as spans", "2 as keys", "'b' as block", "3 as fold", "'z' as rep",
            "4 as leaks", "5 as kept", "6 as lang_pred", "'u' as unit", "7 as batch",
        ).withColumn("decoded", F.lit("d"))

    return make


EDGES = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (None, "a null id with a text of its own"),
    (4, "short"),
    (5, "the same row twice, word for word, and so on"),
    (5, "the same row twice, word for word, and so on"),
    (6, "é中\U0001f600 mixed ÀÉ scripts"),
    (7, "long " * 40_000),
    (8, "x" * 150_000),
]


@pytest.fixture
def edges(table):
    return table(EDGES)


@pytest.fixture
def empty(table):
    return table([])
