"""A model's answers kept by content: a picture is asked about once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.enrich import Describer, describe_images
from quire.session import materialize

STORE = "answer_key string, answer string"


def answer_key(model: str, prompts: dict[str, str] | None = None) -> Column:
    """Hash of what decides an answer: model, prompt, hint, and the picture.

    A request without bytes is known by its ``image_ref`` instead, so only requests for the same file share an answer.
    """
    hinted = F.col("hint").isNotNull() & (F.col("kind") == "hq") & F.lit("hq_hint" in (prompts or {}))
    texts = F.from_json(F.lit(json.dumps(prompts or {})), "map<string,string>")
    prompt = F.coalesce(texts[F.when(hinted, "hq_hint").otherwise(F.col("kind"))], F.lit(""))
    picture = F.when(F.col("content").isNotNull(), F.sha2(F.col("content"), 256)).otherwise(
        F.concat(F.lit("ref:"), "image_ref")
    )
    parts = F.struct(F.lit(model).alias("m"), prompt.alias("p"), F.col("hint").alias("h"), picture.alias("c"))
    return F.sha2(F.to_json(parts), 256)


def known_answers(spark: SparkSession, store: str) -> DataFrame:
    """``answer_key, answer``; of answers that two runs stored for one key, the first in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STORE)
    return spark.read.schema(STORE).parquet(store).groupBy("answer_key").agg(F.min("answer").alias("answer"))


def describe_once(
    requests: DataFrame,
    describer: Describer,
    store: str,
    model: str,
    retries: int = 3,
    base_delay: float = 1.0,
    prompts: dict[str, str] | None = None,
    partitions: int | None = None,
    concurrency: int = 5,
) -> DataFrame:
    """``describe_images`` that asks only what the store of answers at ``store`` does not have.

    Requests that meet a stored answer are not asked. Of those that agree in picture, prompt, hint and model, one is asked,
    for all of them. New answers are appended to the store; errors are not, so a later run tries them again. ``attempts`` is 0 for an
    answer from the store. Only keys meet the store; pictures go to the model alone, each once.
    """
    kept = [c for c in requests.columns if c not in ("content", "hint")]
    keyed = requests.withColumn("answer_key", answer_key(model, prompts))
    known = known_answers(requests.sparkSession, store)
    # Equal requests combine where they are, before one of them is sent on.
    order = F.struct("doc_stem", "page_num", "kind", "index", "image_ref")
    asked = keyed.join(known, "answer_key", "left_anti").groupBy("answer_key").agg(
        F.min_by(F.struct(*requests.columns), order).alias("r")
    )
    asked = asked.select("answer_key", "r.*")
    found = describe_images(asked, describer, retries, base_delay, prompts, partitions, concurrency)
    found = found.select("answer_key", F.col("description").alias("answer"), "error", "attempts")
    # Calls are made once, whatever reads them later.
    found = materialize(found, "answers")
    before = materialize(known.join(keyed.select("answer_key").distinct(), "answer_key", "left_semi"), "answers-met")
    found.where(F.col("error").isNull()).select("answer_key", "answer").write.mode("append").parquet(store)
    met = before.select("answer_key", "answer", F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))
    answers = found.unionByName(met)
    return keyed.select(*kept, "answer_key").join(answers, "answer_key").select(
        *kept, F.col("answer").alias("description"), "error", "attempts"
    )
