import os
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F
from quire import schemas
from quire.operators import enrich, pages as pg
from quire.plans import pipelines

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def requests(spark, rows):
    schema = ("doc_stem string, page_num int, kind string, index int, width int, height int, hint string, "
              "fallback string, content binary, image_ref string")
    return spark.createDataFrame(rows, schema)


def answer(row):
    if row["index"] == 2:
        raise RuntimeError("too dark")
    return f" {row['prompt']}|{row['index']}|{len(row['content'] or b'')} "


def test_describe(spark):
    df = requests(spark, [("d", 0, "img", 1, 5, 6, None, None, b"xyz", "r1"), ("d", 0, "img", 2, 5, 6, None, None, None, "r2"),
                          ("d", 1, "hq", None, None, None, "HINT", "page text", None, "r3"),
                          ("d", 2, "hq", None, None, None, None, None, None, "r4")])
    prompts = {"img": "look", "hq": "read", "hq_hint": "read {hint_text}"}
    out = enrich.describe_images(df, answer, 3, 0.0, prompts, partitions=2)
    got = {r.image_ref: (r.description, r.error, r.attempts, r["index"]) for r in out.collect()}
    assert got == {"r1": ("look|1|3", None, 1, 1), "r2": (None, "failed after 3 attempts: too dark", 3, 2),
                   "r3": ("read HINT|None|0", None, 1, None), "r4": ("read|None|0", None, 1, None)}


class Flaky:
    def __init__(self, path):
        self.path = path

    def __call__(self, row):
        with open(self.path, "a") as f:
            f.write("x")
        if os.path.getsize(self.path) < 3:
            raise RuntimeError("busy")
        return "ok"


def test_retry_until_it_answers(spark, tmp_path):
    df = requests(spark, [("d", 0, "img", 1, 1, 1, None, None, None, "r")])
    row = enrich.describe_images(df, Flaky(str(tmp_path / "n")), 5, 0.0).first()
    assert (row.description, row.error, row.attempts) == ("ok", None, 3)


def test_placeholders(spark):
    cols = "doc_stem string, kind string, description string, error string, fallback string, hint string, content binary"
    rows = [(k, k, None, "E", None, None, None) for k in ("img", "full", "table", "hq")]
    rows += [("hq text", "hq", None, "E", "page", None, None), ("fine", "img", "D", None, None, None, None)]
    got = {r.doc_stem: r.description for r in enrich.settle_descriptions(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"img": "[ไม่สามารถอธิบายภาพได้: E]", "full": "[ไม่สามารถอธิบายภาพได้: E]", "table": "[ไม่สามารถแปลงตารางได้: E]",
                   "hq": "[ไม่สามารถถอดข้อความได้: E]", "hq text": "page", "fine": "D"}


def inputs(spark, pages):
    table = pages({"d": ["first page", "a  b  c\n\nd  e  f\n\ng  h  i", "third page", "bad"]})
    table = table.withColumn("error", F.when(F.col("text") == "bad", "cannot read"))
    box = lambda page, idx, side, px: ("d", page, idx, "image", 100.0, 100.0, 0.0, side, side, 0.0, px, px)
    objects = spark.createDataFrame([box(0, 1, 30.0, 50), box(0, 2, 30.0, 150), box(0, 3, 10.0, 100), box(2, 1, 80.0, 900)], schemas.PAGE_OBJECTS)
    return table, objects


def name(row):
    return "D(" + row["image_ref"].split("/")[1] + ")"


def test_vision_run(spark, pages):
    table, objects = inputs(spark, pages)
    run = pipelines.vision_pipeline(table, objects, name, base_delay=0.0)
    assert run.documents.first().markdown == (
        "# d\n\n> Provider: `ollama` | Model: `qwen2.5vl` | Quality: `standard` | Pages: 4\n\n> Images: `images/d/`\n"
        "\n\n\n---\n## Page 1\n\nfirst page"
        "\n\n[IMAGE:d/d_page_001_img1.png]\n**[ภาพที่ 1]:** D(d_page_001_img1.png)\n"
        "\n\n[IMAGE:d/d_page_001_img2.png]\n**[ภาพที่ 2]:** D(d_page_001_img2.png)\n"
        "\n\n\n---\n## Page 2\n\n\n[IMAGE:d/d_page_002_table.png]\n\nD(d_page_002_table.png)\n"
        "\n\n\n---\n## Page 3\n\nthird page\n\n[IMAGE:d/d_page_003_full.png]\n\nD(d_page_003_full.png)"
        "\n\n\n---\n## Page 4\n[Error: cannot read]\n")
    assert run.counts == {"pages": 4, "page_errors": 1, "images": 4, "image_errors": 0}
    assert {r.type for r in run.catalog.collect()} == {"extracted_image", "table_region", "full_page"}
    assert {r.trash_type for r in run.detections.collect()} == {"blank_page"}


def test_vision_run_in_high_quality(spark, pages):
    table, objects = inputs(spark, pages)
    config = pg.Config(quality="high", detect_trash=False, max_retries=1)

    def only_odd(row):
        if row["page_num"] % 2 == 0:
            raise RuntimeError("no")
        return "x" * 300

    run = pipelines.vision_pipeline(table.drop("error"), objects, only_odd, config, base_delay=0.0)
    text = run.documents.first().markdown
    assert "Quality: `high (vision-first)`" in text
    assert "## Page 1\n\n[IMAGE:d/d_page_001_hq.png]\n\nfirst page" in text
    assert "## Page 2\n\n[IMAGE:d/d_page_002_hq.png]\n\n" + "x" * 300 in text
    assert {len(r.description) for r in run.catalog.where("page % 2 = 0").collect()} == {200}
    assert run.detections.count() == 0


def test_page_pictures_stay_out_of_the_texts(spark, pages, monkeypatch):
    table, objects = inputs(spark, pages)
    table = table.withColumn("page_image", F.concat(F.lit("picture "), F.col("page_num").cast("string")).cast("binary"))
    seen = []
    whole = pipelines.materialize_counted
    monkeypatch.setattr(pipelines, "materialize_counted", lambda df, name, **more: seen.append(df.columns) or whole(df, name, **more))

    def told(row):
        return bytes(row["content"] or b"none").decode()

    run = pipelines.vision_pipeline(table, objects, told, base_delay=0.0)
    text = run.documents.first().markdown
    assert "[IMAGE:d/d_page_002_table.png]\n\npicture 1" in text and "[IMAGE:d/d_page_003_full.png]\n\npicture 2" in text
    assert seen and all("page_image" not in columns for columns in seen)


def test_texts_of_the_vision_run_move_once(spark, pages):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table, objects = inputs(spark, pages)
        run = pipelines.vision_pipeline(table, objects, name, base_delay=0.0)
        plan = run.documents._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    [scan] = [i for i, line in enumerate(lines) if "FileScan" in line and "strategy" in line and "text" in line]
    assert "Bucketed: true" in lines[scan]
    # Between the scan of the texts and the gathering by block there is no exchange.
    depth = lambda line: len(line) - len(line.lstrip(" :|+-*()0123456789"))
    above = [line for line in lines[:scan] if depth(line) < depth(lines[scan])]
    path, least = [], depth(lines[scan])
    for line in reversed(above):
        if depth(line) < least:
            path.append(line)
            least = depth(line)
    assert not [line for line in path if "Exchange" in line]
