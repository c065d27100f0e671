import json

from pyspark.sql import functions as F
from quire.operators import documents, jobs


def resolved(spark, **config):
    text = config.pop("raw", None) or json.dumps(config)
    df = spark.createDataFrame([("j", "f.pdf", text)], "id string, filename string, config string")
    return jobs.resolve_jobs(df, jobs.provider_registry(spark)).first()


def test_settings(spark):
    row = resolved(spark, provider="openai")
    assert (row.model, row.language, row.dpi, row.quality, row.notify) == ("gpt-4o", "th", 200, "standard", True)
    assert (row.table_extraction, row.text_only, row.storage, row.cost_per_image_usd) == (False, False, "local", 0.01)
    assert resolved(spark, provider="x").model == "qwen2.5vl"
    assert resolved(spark, provider="x").known_provider is False
    assert resolved(spark, provider="gemini", language="EN").dpi == 150
    assert resolved(spark, provider="gemini", language="en", quality="High").dpi == 300
    assert resolved(spark, provider="gemini", quality="high", dpi=450).dpi == 450
    assert resolved(spark, provider="gemini", quality="odd").quality == "standard"
    assert resolved(spark, provider="xai", text_only=True, table_extraction=True).table_extraction is False
    for broken in ("{", "[]", '{"language": "en"}', '{"provider": "openai", "dpi": "many"}'):
        row = resolved(spark, raw=broken)
        assert (row.provider, row.model, row.language) == ("ollama", "qwen2.5vl", "th"), broken


def test_latest_state(spark):
    schema = "job_id string, seq long, ts timestamp, status string, progress string, result string, error string"
    t = [f"2026-01-01 00:00:{s:02d}" for s in range(60)]
    rows = [("a", 1, t[0], "pending", None, None, None), ("a", 2, t[5], "processing", None, None, None),
            ("a", 4, t[9], None, "p2", None, None), ("a", 3, t[7], None, "p1", None, None),
            ("a", 5, t[20], "completed", None, "r", None),
            ("b", 1, t[0], "odd", None, None, None), ("b", 2, t[1], None, None, None, "e")]
    events = spark.createDataFrame(rows, "job_id string, seq long, ts string, status string, progress string, result string, error string")
    events = events.withColumn("ts", F.to_timestamp("ts")).select(*[c.split()[0] for c in schema.split(", ")])
    got = {r.job_id: r for r in jobs.latest_job_state(events).collect()}
    a = got["a"]
    assert (a.status, a.progress, a.result, a.error, a.duration_seconds) == ("completed", "p2", "r", None, 15.0)
    assert got["b"].status == "failed" and got["b"].error == "e" and got["b"].duration_seconds is None
    log = spark.createDataFrame([(1, "x", True), (2, "y", False)], "seq int, host string, enabled boolean")
    assert tuple(jobs.latest_settings(log).first()) == ("y", False)


def test_iso_times(spark):
    df = spark.createDataFrame([("2026-02-19T01:12:24Z", "2026-02-19T01:13:24Z"), ("x", "2026-02-19T01:13:24Z")], "a string, b string")
    out = df.select(jobs.duration_seconds(jobs.parse_iso(F.col("a")), jobs.parse_iso(F.col("b"))).alias("d"))
    assert [r.d for r in out.collect()] == [60.0, None]


def test_dashboard_and_recent(spark):
    rows = [("a", "completed", 10.0, 1), ("b", "failed", 20.0, 3), ("c", "processing", None, 3), ("d", "pending", None, 2)]
    df = spark.createDataFrame(rows, "id string, status string, duration_seconds double, created_at int")
    assert tuple(jobs.job_dashboard(df).first()) == (4, 1, 1, 1, 15.0)
    assert [r.id for r in jobs.recent_jobs(df, 2).collect()] == ["b", "c"]
    assert [r.id for r in jobs.recent_jobs(df, None).collect()] == ["b", "c", "d", "a"]


def test_messages(spark):
    rows = [("a", "a.pdf", "completed", True, None, 3, 59.5), ("b", "b.pdf", "failed", None, "bad", None, 125.9),
            ("c", "c.pdf", "completed", False, None, 1, 1.0), ("d", "d.pdf", "cancelled", True, None, 1, 1.0),
            ("e", "e.pdf", "completed", True, None, None, None), ("f", "f.pdf", "completed", True, None, None, 2.5)]
    df = spark.createDataFrame(rows, "id string, filename string, status string, notify boolean, error string, image_count int, duration_seconds double")
    got = {r.id: r.message for r in jobs.notification_feed(df, product="P").collect()}
    assert got == {
        "a": "[P] Job Completed\nFile: a.pdf\nDuration: 60s\nImages: 3",
        "b": "[P] Job Failed\nFile: b.pdf\nDuration: 2m 5s\nError: bad",
        "e": "[P] Job Completed\nFile: e.pdf\nDuration: -",
        "f": "[P] Job Completed\nFile: f.pdf\nDuration: 2s",
    }
    assert jobs.notification_feed(df, enabled=False).count() == 0
    assert {r.id for r in jobs.notification_feed(df, notify_on_failure=False).collect()} == {"a", "e", "f"}
    assert jobs.notification_feed(df, notify_on_failure=False, notify_on_complete=False).count() == 0


def test_results(spark, docs):
    table = spark.createDataFrame([("1", "a.pdf", "completed"), ("2", "b.pdf", "failed"), ("3", "c.pdf", "completed")], "id string, filename string, status string")
    cat = spark.createDataFrame([("a", p, f"i{p}") for p in (5, 1, 9)], "doc_stem string, page int, image_file string")
    det = spark.createDataFrame([("a", 0, "header_footer")], "doc_stem string, page int, trash_type string")
    view = documents.results_view(table, docs({"a": "A", "b": "B"}), cat, det)
    got = {r.job_id: r for r in view.collect()}
    assert set(got) == {"1", "3"}
    assert got["1"].markdown == "A" and [m.page for m in got["1"].metadata] == [1, 5, 9]
    assert (got["1"].image_count, got["1"].trash_count) == (3, 1)
    assert (got["3"].markdown, got["3"].metadata, got["3"].image_count) == (None, None, 0)
    parts = spark.createDataFrame([("a", 1, "second"), ("a", 0, "first")], "doc_stem string, block_no int, markdown string")
    got = documents.results_view(table, parts, cat, det).where("job_id = '1'").collect()
    assert [(r.markdown, r.image_count) for r in got] == [("first\nsecond", 3)]
