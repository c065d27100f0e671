"""Plans and results under the conditions of a large cluster."""

import random
import re

import pytest
from pyspark.sql import functions as F
from quire.fixtures import Views
from quire.operators import boilerplate, documents, images, jobs, keys, markdown, pages as pg
from quire.plans import pipelines

import __spark_entry__ as spark_entry

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df).split("Initial Plan")[0]


@pytest.fixture
def no_broadcast(spark):
    """Tables so large that no side of a join is small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


STREAMS = {"stream_progress", "stream_terminal", "stream_terminal_keyed", "stream_ingest"}
# Sides with a stated bound: the six providers, one row a block of a stored corpus.
BOUNDED = {"resolve_jobs", "search_indexed"}
CORE = {n for n in spark_entry.queries() if not re.match(r"op\d+_|pipeline$", n)}


@pytest.mark.parametrize("name", sorted(CORE - STREAMS))
def test_no_query_pairs_all_rows(no_broadcast, name):
    text = plan(spark_entry.queries()[name](no_broadcast, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text or name in ("job_dashboard", "recent_jobs")
    if name not in BOUNDED:
        assert "BroadcastHashJoin" not in text


def test_texts_are_cleaned_and_shuffled_once(no_broadcast):
    pages = Views(no_broadcast, FOLDER).page_texts
    text = final_plan(pipelines.text_only_pipeline(pages).documents)
    spread = [line for line in text.splitlines() if "REPARTITION_BY_COL" in line]
    assert ["ReusedExchange" in line for line in spread].count(False) == 1
    assert ["ReusedExchange" in line for line in spread].count(True) == 1
    # Assembly finds the pages of a block together: both steps of the gathering run in
    # one stage, with no exchange in between.
    gathered = text[text.index("functions=[collect_list(struct(page_num"):].splitlines()
    assert "partial_collect_list(struct(page_num" in gathered[1]


def test_narrow_operators_do_not_shuffle(spark):
    v = Views(spark, FOLDER)
    for df in (pg.cleanup_text(v.page_texts), pg.flag_table_pages(v.page_texts), spark_entry.detect.detect_trash(v.page_texts),
               pg.page_range(v.page_texts, 1, 5), jobs.notification_feed(v.jobs)):
        assert "Exchange" not in plan(df)


def test_scans_read_only_what_is_used(spark, tmp_path):
    v = Views(spark, FOLDER)
    assert "ReadSchema: struct<doc_id:bigint>" in plan(keys.document_blocks(v.page_texts))
    v.page_texts.write.parquet(str(tmp_path / "p"))
    text = plan(pg.page_range(spark.read.parquet(str(tmp_path / "p")), 2, 9))
    assert "GreaterThanOrEqual(page_num,2)" in text and "LessThan(page_num,9)" in text


def test_only_frequent_lines_are_ranked(no_broadcast):
    text = plan(boilerplate.headers_footers(Views(no_broadcast, FOLDER).page_texts))
    assert text.count("WindowGroupLimit") == 2


def test_top_jobs_are_not_sorted_in_full(spark):
    assert "TakeOrderedAndProject" in plan(jobs.recent_jobs(Views(spark, FOLDER).jobs))


@pytest.fixture
def skewed(spark):
    """One document with most of the pages beside many small ones."""
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma.", "delta:", "  x", "\n", "\n\n", "- item"]
    rows = []
    for n in range(3000):
        stem, page = ("hot", n) if n < 2000 else (f"d{n % 97}", n // 97)
        body = " ".join(rng.choices(words, k=12))
        rows.append((stem, page, f"Head of {stem}\n\n{body}\n\nline {rng.random()}\n\nFoot."))
    return spark.createDataFrame(rows, "doc_stem string, page_num int, text string").repartition(6)


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_stem, r.block_no)):
        out.setdefault(r.doc_stem, []).append(r.markdown)
    return {stem: "\n".join(parts) for stem, parts in out.items()}


def test_hot_document_is_spread(no_broadcast, skewed):
    whole = pipelines.text_only_pipeline(skewed, block_pages=5000)
    spread = pipelines.text_only_pipeline(skewed, block_pages=64)
    assert joined(whole.documents) == joined(spread.documents)
    assert spread.documents.where("doc_stem = 'hot'").count() == 32
    sizes = [r["count"] for r in pipelines.cleaned_by_block(skewed, 64).groupBy("doc_stem", "block_no").count().collect()]
    assert max(sizes) == 64
    key = lambda r: (r.doc_stem, r.page, r.trash_type)
    assert sorted(whole.detections.collect(), key=key) == sorted(spread.detections.collect(), key=key)


def test_hot_job(no_broadcast):
    rows = no_broadcast.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("j"), (F.col("id") % 50).cast("string"))).alias("job_id"),
        F.col("id").alias("seq"),
        F.timestamp_seconds("id").alias("ts"),
        F.when(F.col("id") % 7 == 0, "processing").alias("status"),
        F.when(F.col("id") % 5 == 0, F.col("id").cast("string")).alias("progress"),
        F.lit(None).cast("string").alias("result"),
        F.lit(None).cast("string").alias("error"),
    )
    state = jobs.latest_job_state(rows)
    assert "partial_max_by" in plan(state) and "Window" not in plan(state)
    hot = state.where("job_id = 'hot'").first()
    assert hot.progress == "19995" and hot.updated_at.timestamp() == 19998


def test_page_with_very_many_images(no_broadcast):
    objects = no_broadcast.range(5000).select(
        F.lit("d").alias("doc_stem"), F.lit(0).alias("page_num"), F.col("id").alias("obj_idx"), F.lit("image").alias("kind"),
        (90 + F.col("id") % 20).cast("int").alias("px_w"), F.lit(100).alias("px_h"))
    got = images.keep_large_images(objects, block_width=100)
    assert got.count() == 2500
    assert got.agg(F.max("index"), F.countDistinct("index")).first()[:] == (2500, 2500)
    ordered = [r["index"] for r in got.orderBy("obj_idx").collect()]
    assert ordered == list(range(1, 2501))


def test_edits_shuffle_a_document_once(no_broadcast):
    v = Views(no_broadcast, FOLDER)
    docs = v.markdown_docs.withColumn("block_no", F.lit(0))
    text = plan(markdown.remove_pages(docs, v.removals))
    assert "LeftSemi" in text
    assert "Generate" in text


def test_stats_of_spread_documents(skewed, spark):
    none = spark.createDataFrame([], "doc_stem string, page int")
    one, many = (
        documents.document_stats(pipelines.text_only_pipeline(skewed, block_pages=b).documents, none, none) for b in (5000, 64)
    )
    assert sorted(one.collect()) == sorted(many.collect())
