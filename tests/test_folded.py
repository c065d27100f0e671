import datetime
import os
import random

import pytest
from pyspark.sql import functions as F
from quire.streaming import folded, keyed, progress

SCHEMA = "job_id string, seq long, ts timestamp, current_page int, total_pages int, new_images int, phase string"
START = datetime.datetime(2024, 1, 1)


def events(spark, rows):
    """Rows of (job, seq, minute, new images, phase)."""
    full = [(j, s, START + datetime.timedelta(minutes=m), s % 7, 9, n, p) for j, s, m, n, p in rows]
    return spark.createDataFrame(full, SCHEMA).coalesce(1)


def batches(n, seed=0):
    """Each batch: rows of a job that lasts, of jobs that start and end, and now and then a late row."""
    rng = random.Random(seed)
    for b in range(n):
        rows = [("hot", 3 * b + k, b, 1, "processing") for k in range(3)]
        rows += [(f"j{b}", 1, b, 2, "starting"), (f"j{b}", 2, b, 3, "complete")]
        if b > 10 and rng.random() < 0.3:
            rows.append((f"j{rng.randrange(b - 8)}", 3 + b, b, 5, "processing" if rng.random() < 0.5 else "complete"))
        yield rows


def state(df):
    return {r.job_id: (r.seq, r.phase, r.images_processed) for r in df.collect()}


def plain(rows):
    out = {}
    for job, seq, _, images, phase in rows:
        old = out.get(job, (-1, "", 0))
        out[job] = (*((seq, phase) if seq > old[0] else old[:2]), old[2] + images)
    return out


def folders(path):
    return {p: sorted(int(n) for n in os.listdir(f"{path}/{p}")) for p in os.listdir(path) if os.path.isdir(f"{path}/{p}")}


def test_state_and_folders_stay_level(spark, tmp_path):
    table = progress._progress_table(spark, str(tmp_path), 5, "6 MINUTES")
    old, seen, sizes, counts = spark.conf.get("spark.sql.shuffle.partitions"), [], [], []
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for b, rows in enumerate(batches(100)):
            seen += rows
            table.add(progress._progress_partials(events(spark, rows)), b)
            if b % 5 == 4:
                sizes.append(table._rows("snapshot", [b]).count())
                counts.append(sum(map(len, folders(tmp_path).values())))
                if b % 35 == 34:
                    assert state(table.read()) == plain(seen)
        assert state(table.read()) == plain(seen)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    # Jobs come at one a batch and stay for six minutes and the batches up to the next snapshot.
    assert max(sizes[3:]) <= 18 and max(sizes[15:]) <= max(sizes[3:11]) + 3 and max(counts[3:]) <= 22
    assert len(state(table.read(settled=False))) <= 25


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    table = progress._progress_table(spark, str(tmp_path), 3, "2 MINUTES")
    seen = []
    for b, rows in enumerate(batches(9, 1)):
        seen += rows
        partials = progress._progress_partials(events(spark, rows))
        if b in (2, 5, 8):
            # The fold breaks off before each of its writes in turn, and the batch runs again.
            for part in ("merged", "settled", "archive", "snapshot"):
                whole = folded.Folded._write

                def broken(self, df, to, number, part=part, whole=whole):
                    if to == part:
                        raise RuntimeError("lost")
                    whole(self, df, to, number)

                monkeypatch.setattr(folded.Folded, "_write", broken)
                try:
                    table.add(partials, b)
                except RuntimeError:
                    assert part != "archive" or b == 8
                monkeypatch.setattr(folded.Folded, "_write", whole)
                assert state(table.read()) == plain(seen)
        table.add(partials, b)
        table.add(partials, b)
        assert state(table.read()) == plain(seen)


def test_progress_stream_with_a_trigger(spark, tmp_path):
    everything = []
    for rows in batches(4, 2):
        everything += rows
        events(spark, rows).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running = progress.stream_progress(
        source, f"{tmp_path}/out", f"{tmp_path}/cp", trigger={"processingTime": "0 seconds"}, every=2, retention="1 HOUR"
    )
    running.processAllAvailable()
    assert running.isActive
    events(spark, [("new", 1, 50, 4, "starting")]).write.mode("append").parquet(f"{tmp_path}/in")
    running.processAllAvailable()
    running.stop()
    assert state(progress.read_progress(spark, f"{tmp_path}/out")) == {**plain(everything), "new": (1, "starting", 4)}


def test_ends_are_forgotten_after_their_time(spark, tmp_path):
    rows = [[("a", 1, 0, 0, "complete"), ("a", 2, 0, 0, "processing")], [("b", 1, 30, 0, "complete"), ("a", 3, 30, 0, "processing")],
            [("c", 1, 90, 0, "complete"), ("b", 2, 90, 0, "processing")], [("a", 4, 91, 0, "processing"), ("c", 2, 91, 0, "processing")]]
    for part in rows:
        events(spark, part).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        progress.stream_terminal(source, f"{tmp_path}/out", f"{tmp_path}/cp", snapshot_every=1, retention="1 HOUR").awaitTermination()
    got = sorted((r.job_id, r.seq) for r in spark.read.parquet(f"{tmp_path}/out/feed").collect())
    assert got == [("a", 1), ("a", 4), ("b", 1), ("c", 1)]
    [last] = folders(f"{tmp_path}/out/ends")["snapshot"][-1:]
    left = spark.read.parquet(f"{tmp_path}/out/ends/snapshot/{last}").collect()
    assert {r.job_id for r in left} == {"b", "c"}


def keyed_run(spark, folder, **more):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = keyed.stream_terminal_keyed(source, f"{folder}/out", f"{folder}/cp", "10 minutes", 3_600_000, **more)
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_keyed_state_leaves_by_timers(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(keyed._PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        kept = []
        # Each run is a restart from the checkpoint.
        for rows in [
            [("a", 1, 0, 0, "starting"), ("a", 3, 2, 0, "complete"), ("a", 2, 1, 0, "processing"), ("a", 4, 3, 0, "error"), ("b", 1, 0, 0, "starting")],
            [("a", 5, 20, 0, "processing"), ("b", 2, 20, 0, "processing")],
            [("a", 6, 50, 0, "processing"), ("b", 4, 50, 0, "error"), ("b", 3, 50, 0, "processing")],
            [(f"j{n}", 1, 60 + n, 0, "complete") for n in range(40)],
            [("b", 5, 100, 0, "processing"), ("z", 1, 400, 0, "starting")],
            [("z", 2, 401, 0, "processing")],
        ]:
            events(spark, rows).write.mode("append").parquet(f"{tmp_path}/in")
            kept.append(keyed_run(spark, tmp_path)[-1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set(keyed._PROVIDER, old[1])
    got = sorted((r.job_id, r.seq) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("z", 1), ("z", 2)]
    assert [g for g in got if g[0][0] != "j"] == want and len(got) == len(want) + 40
    assert kept[0] == 1 and max(kept) <= 42 and kept[-1] == 0
