"""Queries of the operators over whole tables, and their DuckDB statements where SQL has them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    align,
    ann,
    bpe,
    decontaminate,
    language,
    lm,
    neardup,
    packing,
    pii,
    repeats,
    toxicity,
    variants,
    wordbpe,
)
from quire.llm.common import fold, table

JSON_50K = "byte_bpe_50k.json"
RANKS_50K = "byte_bpe_50k.tiktoken"
VOCABULARY_50K = 50_257
WORDS_49K = "word_bpe_49k.json"
PIECES_32K = "piece_bpe_32k.model"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The stages take any frame with doc_id and text, and return its columns. A null or empty text is kept as it is, by
# every stage; a null doc_id is a document of its own. Rows of one id share what is decided of it. Long texts are
# taken whole. An empty frame gives an empty one. Other columns pass through; one named like an output of the
# stage's operator (``score``, ``leaks``, ``base``, ``spans``) comes back as that output.


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return ann.nearest(vectors, F.col("id") % 100 == 0, 10).withColumnRenamed("id", "vec_id")


def _toxicity_scores(docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(docs.sparkSession, sf_dir, "labels")
    model = toxicity.fit(table(docs.sparkSession, sf_dir, "documents"), labels, fold("doc_id", 3) != 1)
    return toxicity.score(docs, model)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _toxicity_scores(docs, sf_dir).select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    scored = _toxicity_scores(docs, sf_dir)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = language.profiles(docs, fold("doc_id", 4) != 2)
    return language.identify(docs.select("doc_id", "text"), known).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return neardup.near_duplicates(docs, words=3, percent=85, bands=32, rows=8)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    return neardup.drop_duplicates_of(docs)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed_digests(spark, docs, public_tokenizers.path(JSON_50K), VOCABULARY_50K)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out, tuning = fold("doc_id", 5) == 1, fold("doc_id", 5) == 0
    parts = F.when(held_out, 0).when(tuning, 1).otherwise(2)
    scored = lm.score(table(spark, sf_dir, "documents"), parts)
    return scored.select(
        "doc_id",
        (F.col("fold") == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path(RANKS_50K))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    redacted = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    kind = docs.schema["n_chars"].dataType
    return redacted.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), "n_chars"))


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path(RANKS_50K))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS_49K))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path(JSON_50K), public_tokenizers.path(PIECES_32K)
    return align.report(table(spark, sf_dir, "documents"), *files)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"), shortest=5, least=3, ratio=2, part=97)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_nearest": op2_nearest,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_repeats": op6_repeats,
    "op7_token_files": op7_token_files,
    "op8_lm_scores": op8_lm_scores,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_personal_data": op10_personal_data,
    "op11_word_bpe": op11_word_bpe,
    "op12_alignment": op12_alignment,
    "op13_spelling_variants": op13_spelling_variants,
}

# The CRC of a run is folded over its bytes by the table of the reversed polynomial; near words share
# what is left of them without one letter, or with a blank in its place.
_OP13 = """
WITH RECURSIVE bits AS (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS h FROM runs WHERE length(run) >= 5 GROUP BY id, run),
hashed AS (SELECT run, c, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS h FROM counted, crc),
altered AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM altered WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
edits AS (SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS blank, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
pairs AS (SELECT a.word, b.word AS near, b.n FROM edits a JOIN edits b ON a.blank = b.blank AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM edits a JOIN words b ON a.less = b.word
    UNION SELECT b.word, a.word, a.n FROM edits a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n,
    CASE WHEN b.near_n >= 2 * w.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.n = b.near_n) END AS form
    FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS root, form AS following FROM forms
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.following = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word AND c.following IS NULL
"""

ORACLE_SQL: dict[str, str] = {"op13_spelling_variants": _OP13}
