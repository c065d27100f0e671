import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from quire.streaming import progress

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "job_id string, seq long, current_page int, total_pages int, new_images int, phase string"


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


BATCHES = [
    [("a", 1, 0, 9, 0, "starting"), ("b", 1, 0, 4, 0, "starting"), ("a", 2, 1, 9, 2, "processing")],
    [("b", 3, 2, 0, 0, "error"), ("b", 2, 2, 4, 1, "processing"), ("b", 4, 3, 4, 5, "processing")],
    [("b", 5, 4, 4, 1, "complete"), ("a", 3, 2, 9, 1, "processing"), ("c", 1, 0, 0, 0, "cancelled"), ("c", 2, 1, 1, 0, "processing")],
]


def test_progress(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        write(spark, tmp_path, i, rows)
        progress.stream_progress(stream(spark, tmp_path), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.job_id: (r.seq, r.phase, r.current_page, r.images_processed) for r in progress.read_progress(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": (3, "processing", 2, 3), "b": (5, "complete", 4, 7), "c": (2, "processing", 1, 0)}
    batch = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in")
    assert {r.job_id: r.images_processed for r in progress.progress_state(batch).collect()} == {"a": 3, "b": 7, "c": 0}


def feed(spark, tmp_path, **k):
    for i, rows in enumerate(BATCHES):
        write(spark, tmp_path, i, rows)
        progress.stream_terminal(stream(spark, tmp_path), f"{tmp_path}/out", f"{tmp_path}/cp", **k).awaitTermination()
    return sorted((r.job_id, r.seq) for r in spark.read.parquet(f"{tmp_path}/out/feed").collect())


def test_feed_ends_at_the_first_terminal_row(spark, tmp_path):
    assert feed(spark, tmp_path) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3), ("c", 1)]


def test_feed_with_snapshots(spark, tmp_path):
    rows = [("a", 1, 0, 9, 0, "starting"), ("b", 1, 0, 4, 0, "starting"), ("b", 2, 0, 4, 0, "error")]
    write(spark, tmp_path, 0, rows)
    for n in range(2, 7):
        write(spark, tmp_path, n, [("a", n, n, 9, 0, "complete" if n == 4 else "processing"), ("b", n + 1, n, 4, 0, "processing")])
    source = stream(spark, tmp_path)
    progress.stream_terminal(source, f"{tmp_path}/out", f"{tmp_path}/cp", snapshot_every=2).awaitTermination()
    got = sorted((r.job_id, r.seq) for r in spark.read.parquet(f"{tmp_path}/out/feed").collect())
    assert spark.read.parquet(f"{tmp_path}/out/feed").select("batch_id").distinct().count() >= 4
    assert got == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1), ("b", 2)]
    last = spark.read.parquet(f"{tmp_path}/out/ends/snapshot/5")
    assert sorted(tuple(r)[:2] for r in last.collect()) == [("a", 4), ("b", 2)]


def test_feed_with_other_terminal_phases(spark, tmp_path):
    got = feed(spark, tmp_path, terminal_phases=["complete", "cancelled"])
    assert [s for j, s in got if j == "b"] == [1, 2, 3, 4, 5]


def pages_of(content):
    return content.decode().split("|")


def test_ingest(spark, tmp_path):
    box = tmp_path / "in"
    os.makedirs(box)

    def run():
        progress.stream_ingest(spark, str(box), f"{tmp_path}/out", pages_of, f"{tmp_path}/cp", "en").awaitTermination()

    (box / "a.pdf").write_bytes(b"first page|second page")
    (box / "skip.txt").write_bytes(b"x")
    run()
    (box / "b.pdf").write_bytes(b"only page")
    run()
    run()
    docs = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out/batch_id=*/markdown")
    got = {r.doc_stem: r.markdown for r in docs.collect()}
    assert set(got) == {"a", "b"} and docs.count() == 2
    assert got["b"].endswith("## Page 1\n\nonly page")


def test_ingest_of_many_small_files_takes_few_tasks_and_jobs(spark, tmp_path):
    box = tmp_path / "many"
    box.mkdir()
    for n in range(40):  # more paths than Spark looks up by itself at the driver
        (box / f"f{n}.pdf").write_bytes(b"one")
    lines = lambda content: [content.decode()]
    query = progress.stream_ingest(spark, str(box), f"{tmp_path}/out", lines, f"{tmp_path}/cp", "en")
    query.awaitTermination()
    docs = spark.read.parquet(f"{tmp_path}/out/batch_id=*/markdown")
    assert docs.select("doc_stem").distinct().count() == docs.count() == 40
    told = spark.sparkContext.statusTracker()
    jobs = told.getJobIdsForGroup(str(query.runId))
    stages = [told.getStageInfo(s) for j in jobs for s in told.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < 40
    assert len(jobs) < 24  # headers are found once, not for their table and again for the stripped pages


def boxed(tmp_path, count):
    box = tmp_path / "in"
    box.mkdir()
    for n in range(count):
        (box / f"f{n}.pdf").write_bytes(b"Top\n\nfirst %d|Top\n\nsecond|Top\n\nthird" % n)
    return str(box)


def texts(spark, out):
    docs = spark.read.schema("doc_stem string, block_no int, markdown string").parquet(f"{out}/batch_id=*/markdown")
    return sorted((r.doc_stem, r.markdown) for r in docs.collect())


def test_batches_that_wait_together_are_one_run(spark, tmp_path, monkeypatch):
    runs = []
    real = progress.pipelines.text_only_pipeline
    monkeypatch.setattr(progress.pipelines, "text_only_pipeline", lambda *a, **k: runs.append(1) or real(*a, **k))
    box, out = boxed(tmp_path, 8), f"{tmp_path}/out"
    progress.stream_ingest(spark, box, out, pages_of, f"{tmp_path}/cp", "en", max_files=1).awaitTermination()
    assert len(runs) < 4  # and not one for each of the eight batches
    found = texts(spark, out)
    assert [name for name, _ in found] == [f"f{n}" for n in range(8)]
    assert found[3][1].startswith("# f3\n\n> Mode: `text-only` | Language: `en` | Pages: 3\n")
    assert "first 3" in found[3][1] and "Top" not in found[3][1]
    for n in range(8):  # each batch has all tables, also those without rows
        for name, rows in (("pages", 3), ("markdown", 1), ("images_metadata", 0), ("trash", 4)):
            table = spark.read.parquet(f"{out}/batch_id={n}/{name}")
            assert table.count() == rows and "batch_id" not in table.columns
            assert os.path.exists(f"{out}/batch_id={n}/{name}/_SUCCESS")
    assert not os.listdir(f"{out}/_waiting") or all(f.endswith(".crc") for f in os.listdir(f"{out}/_waiting"))


def test_documents_of_one_name_in_several_batches_stay_apart(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"in{n}").mkdir()
        (tmp_path / f"in{n}" / "a.pdf").write_bytes(b"text %d" % n)
    out = f"{tmp_path}/out"
    progress.stream_ingest(spark, f"{tmp_path}/in*", out, pages_of, f"{tmp_path}/cp", "en", max_files=1).awaitTermination()
    found = texts(spark, out)
    assert [name for name, _ in found] == ["a"] * 4
    assert all(t.startswith("# a\n") and t.count("## Page") == 1 for _, t in found)
    assert sorted(t[-6:] for _, t in found) == [f"text {n}" for n in range(4)]


def test_batches_left_behind_are_finished_by_the_next_start(spark, tmp_path, monkeypatch):
    box, out, calls = boxed(tmp_path, 3), f"{tmp_path}/out", f"{tmp_path}/calls"

    def counted(content):
        with open(calls, "a") as f:
            f.write("x")
        return content.decode().split("|")

    def run():
        progress.stream_ingest(spark, box, out, counted, f"{tmp_path}/cp", "en", max_files=1).awaitTermination()

    def lost(*a, **k):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(progress, "write_tables", lost)
    monkeypatch.setattr(progress, "place_parts", lost)
    with pytest.raises(Exception, match="the driver is lost"):
        run()
    waiting = [n for n in os.listdir(f"{out}/_waiting") if n.isdigit()]
    assert waiting and not os.path.exists(f"{out}/batch_id=0/markdown")
    monkeypatch.undo()
    run()
    assert [name for name, _ in texts(spark, out)] == ["f0", "f1", "f2"]
    assert not [n for n in os.listdir(f"{out}/_waiting") if n.isdigit()]


def test_a_file_over_the_limit_is_an_error_row_and_is_not_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"one|two")
    with open(tmp_path / "in" / "large.pdf", "wb") as f:
        f.truncate(2_200_000_000)  # more than a row holds
    out = f"{tmp_path}/out"
    progress.stream_ingest(spark, f"{tmp_path}/in", out, pages_of, f"{tmp_path}/cp", "en").awaitTermination()
    assert [name for name, _ in texts(spark, out)] == ["a", "large"]
    assert "2200000000 bytes is over the limit" in dict(texts(spark, out))["large"]
