import datetime
import random

from pyspark.sql import functions as F
from quire.operators import jobs
from quire.plans import pipelines, reported
from quire.streaming import ledger, progress

SCHEMA = "job_id string, seq bigint, ts timestamp, status string, progress string, result string, error string"


def updates(rng, batch):
    start = datetime.datetime(2024, 3, 1)
    rows = []
    for _ in range(12):
        job, seq = f"j{rng.randrange(6)}", rng.randrange(10_000)
        one = lambda *values: rng.choice([None, *values])
        rows.append((job, seq, start + datetime.timedelta(seconds=seq), one("pending", "processing", "completed", "odd"),
                     one("p1", "p2"), one(f"r{batch}"), one("bad")))
    return rows


def unique(rows, seen):
    return [r for r in rows if (r[0], r[1]) not in seen and not seen.add((r[0], r[1]))]


def test_ledger_equals_the_batch_query_after_every_batch(spark, tmp_path):
    rng, seen, given = random.Random(3), set(), []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for batch in range(8):
            rows = unique(updates(rng, batch), seen)
            given += rows
            events = spark.createDataFrame(rows, SCHEMA)
            for _ in range(2 if batch % 3 else 1):  # some come twice
                ledger.fold_updates(events, str(tmp_path), batch, every=3)
            got = sorted(ledger.read_ledger(spark, str(tmp_path)).collect())
            whole = jobs.latest_job_state(spark.createDataFrame(given, SCHEMA))
            assert got == sorted(whole.select(*got[0].asDict()).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_ledger_stream_reads_only_new_updates(spark, tmp_path):
    rng, seen = random.Random(5), set()
    for batch in range(3):
        spark.createDataFrame(unique(updates(rng, batch), seen), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = ledger.stream_ledger(source, f"{tmp_path}/out", f"{tmp_path}/cp")
        query.awaitTermination()
        assert query.lastProgress["numInputRows"] <= 12
    got = sorted(ledger.read_ledger(spark, f"{tmp_path}/out").collect())
    whole = jobs.latest_job_state(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    assert got == sorted(whole.select(*got[0].asDict()).collect())


def text_run(pages):
    return pipelines.text_only_pipeline(pages, "en", keep_pages=True)


def test_events_of_a_run(spark, pages, tmp_path):
    table = pages({f"d{i}": [f"page {k} of {i}" for k in range(i + 1)] for i in range(9)})
    out, events = f"{tmp_path}/out", f"{tmp_path}/events"
    counts = reported.reported_run(table, text_run, out, events, waves=3)
    assert counts == {"documents": 9, "pages": 45, "page_errors": 0, "images": 0}
    assert text_run(table).counts == {"pages": 45, "page_errors": 0}
    docs = spark.read.option("basePath", f"{out}/results").parquet(f"{out}/results/wave=*/markdown")
    assert sorted(r.doc_stem for r in docs.collect()) == [f"d{i}" for i in range(9)]
    source = reported.stream_events(spark, events, max_files=1)
    progress.stream_progress(source, f"{tmp_path}/p", f"{tmp_path}/cp").awaitTermination()
    state = {r.job_id: (r.seq, r.phase, r.images_processed) for r in progress.read_progress(spark, f"{tmp_path}/p").collect()}
    assert state == {f"d{i}": (3 * i + 4, "complete", 0) for i in range(9)}
    # Given again, the run writes nothing anew and tells the same.
    files = sorted(p.name for p in (tmp_path / "events").rglob("part-*"))
    assert reported.reported_run(table, text_run, out, events, waves=3) == counts
    assert files == sorted(p.name for p in (tmp_path / "events").rglob("part-*"))


def test_a_run_that_breaks_off_goes_on(spark, pages, tmp_path):
    table = pages({f"d{i}": ["one", "two"] for i in range(12)})
    done = []

    def fails_once(some):
        done.append(sorted({r.doc_stem for r in some.collect()}))
        if len(done) == 2:
            raise RuntimeError("driver lost")
        return text_run(some)

    out, events = f"{tmp_path}/out", f"{tmp_path}/events"
    try:
        reported.reported_run(table, fails_once, out, events, waves=3)
        raise AssertionError("should have failed")
    except RuntimeError:
        pass
    counts = reported.reported_run(table, fails_once, out, events, waves=3)
    assert counts == {"documents": 12, "pages": 24, "page_errors": 0, "images": 0}
    assert done[2] == done[1] and len(done) == 4  # the first wave was not done again
    told = reported.read_events(spark, events)
    assert told.count() == told.select("job_id", "seq").distinct().count() == 12 * (2 + 2 * 2)


def test_events_of_a_run_with_a_model(spark, pages, tmp_path):
    from quire import schemas

    table = pages({"d": ["first", "second"], "e": ["only"]})
    box = lambda stem, page, idx, side, px: (stem, page, idx, "image", 100.0, 100.0, 0.0, side, side, 0.0, px, px)
    objects = spark.createDataFrame([box("d", 0, 1, 30.0, 150), box("d", 0, 2, 30.0, 160), box("d", 1, 1, 30.0, 170)], schemas.PAGE_OBJECTS)

    def answer(row):
        if row["width"] == 160:
            raise RuntimeError("too dark")
        return "seen"

    seen = []

    def run(some):
        seen.append(pipelines.vision_pipeline(some, objects.join(some.select("doc_stem").distinct(), "doc_stem", "left_semi"), answer, base_delay=0.0))
        return seen[-1]

    counts = reported.reported_run(table, run, f"{tmp_path}/o", f"{tmp_path}/ev", waves=2)
    total = {k: sum(o.counts[k] for o in seen) for k in ("pages", "images", "image_errors")}
    assert total["pages"] == counts["pages"] == 3
    assert counts["images"] == total["images"] - total["image_errors"] == 2
    assert counts["page_errors"] == 1
    progress.stream_progress(reported.stream_events(spark, f"{tmp_path}/ev"), f"{tmp_path}/p", f"{tmp_path}/cp").awaitTermination()
    state = {r.job_id: r.images_processed for r in progress.read_progress(spark, f"{tmp_path}/p").collect()}
    assert state == {"d": 2, "e": 0}
    [failed] = reported.read_events(spark, f"{tmp_path}/ev").where(F.col("phase") == "error").collect()
    assert (failed.current_page, failed.seq) == (1, 2) and "too dark" in failed.message
