"""A corpus run: each stage applies one operator to what the stage before it kept.

Stages take any frame with ``doc_id`` and ``text``; all but the last return its columns. Null and empty texts and null
ids are kept, rows of one id share a decision, long texts are taken whole, and an empty table gives an empty one.
Each stage's rows are a table in the shared folder, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import queries
from quire.session import materialize

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", queries.stage_toxicity),
    ("near_duplicates", queries.stage_near_duplicates),
    ("decontaminate", queries.stage_decontaminate),
    ("personal_data", queries.stage_personal_data),
    ("byte_bpe", queries.stage_byte_bpe),
]

# No stage is expressible in SQL as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
