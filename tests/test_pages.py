from pyspark.sql import functions as F
from quire.operators import boilerplate, documents, pages as pg
from quire.plans import pipelines


def test_page_range(pages):
    table = pages({"d": ["a", "b", "c", "d"]})
    assert [r.text for r in pg.page_range(table, 1, 3).orderBy("page_num").collect()] == ["b", "c"]
    assert pg.page_range(table, 2).count() == 2
    assert pg.page_range(table, 0, 99).count() == 4


def routed(spark, **row):
    base = {"doc_stem": "d", "page_num": 0, "text": "body", "strategy": "mixed", "table_candidate": False}
    schema = "doc_stem string, page_num int, text string, strategy string, table_candidate boolean"
    return spark.createDataFrame([{**base, **row}], schema)


def answers(spark, rows):
    schema = "doc_stem string, page_num int, kind string, `index` int, image_ref string, description string"
    return spark.createDataFrame([("d", 0, *r) for r in rows], schema)


def body(spark, described, **row):
    return pg.assemble_pages(routed(spark, **row), answers(spark, described)).first().content


def test_bodies_by_strategy(spark):
    head = "\n\n---\n## Page 1\n"
    assert body(spark, [("full", None, "r", "D")], strategy="full_page") == head + "\nbody\n\n[IMAGE:r]\n\nD"
    assert body(spark, [("full", None, "r", "D")], strategy="full_page", text="") == head + "\n[IMAGE:r]\n\nD"
    assert body(spark, [("hq", None, "r", "D")], strategy="high_quality") == head + "\n[IMAGE:r]\n\nD"
    assert body(spark, []) == head + "\nbody"
    assert body(spark, [], text="") == head
    images = [("img", 2, "r2", "two"), ("img", 1, "r1", "one"), ("img", 10, "r10", "ten")]
    want = "".join(f"\n\n[IMAGE:r{n}]\n**[ภาพที่ {n}]:** {d}\n" for n, d in ((1, "one"), (2, "two"), (10, "ten")))
    assert body(spark, images) == head + "\nbody" + want
    table = [("table", None, "t", "T"), ("img", 1, "r1", "one")]
    got = body(spark, table, table_candidate=True)
    assert got == head + "\n\n[IMAGE:t]\n\nT\n" + "\n\n[IMAGE:r1]\n**[ภาพที่ 1]:** one\n"


def test_error_page(spark):
    table = routed(spark).withColumn("error", F.lit("broken"))
    got = pg.assemble_pages(table, answers(spark, [])).first().content
    assert got == "\n\n---\n## Page 1\n[Error: broken]\n"


def test_routing(spark, pages):
    table = pages({"d": ["plain", "plain", "a  b  c\n\nd  e  f\n\ng  h  i", "plain"]})
    shares = spark.createDataFrame(
        [("d", 0, 0.5), ("d", 1, 0.49), ("d", 2, 0.1)], "doc_stem string, page_num int, coverage double"
    )
    got = pg.route_pages(pg.cleanup_text(table), shares).orderBy("page_num").collect()
    assert [r.strategy for r in got] == ["full_page", "mixed", "mixed", "mixed"]
    assert [r.table_candidate for r in got] == [False, False, True, False]
    off = pg.route_pages(table, shares, pg.Config(table_extraction=False))
    assert off.where("table_candidate").count() == 0
    assert {r.strategy for r in pg.route_pages(table, shares, pg.Config(quality="HIGH")).collect()} == {"high_quality"}


def whole(df):
    """Documents from their rows: rows in order, joined by a newline."""
    rows = sorted((r.doc_stem, r.block_no, r.markdown) for r in df.collect())
    out = {}
    for stem, _, text in rows:
        out[stem] = text if stem not in out else out[stem] + "\n" + text
    return out


def sample(n):
    return [f"Top line\n\npage {i} has words.\n\nFoot" for i in range(n)]


def test_text_only_document(pages):
    run = pipelines.text_only_pipeline(pages({"d": sample(3), "e": ["only", ""]}), "en")
    texts = whole(run.documents)
    assert texts["d"] == (
        "# d\n\n> Mode: `text-only` | Language: `en` | Pages: 3\n"
        "\n\n\n---\n## Page 1\n\npage 0 has words."
        "\n\n\n---\n## Page 2\n\npage 1 has words."
        "\n\n\n---\n## Page 3\n\npage 2 has words."
    )
    assert texts["e"].endswith("Pages: 2\n\n\n\n---\n## Page 1\n\nonly\n\n\n---\n## Page 2\n")
    hf = [r for r in run.detections.collect() if r.trash_type == "header_footer"]
    assert [(r.doc_stem, r.page) for r in hf] == [("d", 0)]


def test_document_rows_join_to_the_same_text(pages):
    table = pages({"a": sample(23), "b": sample(4), "c": [""]})
    one = whole(pipelines.text_only_pipeline(table).documents)
    for block in (1, 3, 4, 23):
        df = pipelines.text_only_pipeline(table, block_pages=block).documents
        assert whole(df) == one
        later = df.where("block_no > 0").collect()
        assert all(r.markdown.startswith("## Page ") for r in later)


def test_kept_pages_change_nothing(pages):
    table = pages({"a": sample(5), "b": ["x" * 60, "", "Copyright"]})
    lazy, kept = (pipelines.text_only_pipeline(table, keep_pages=k) for k in (False, True))
    assert whole(lazy.documents) == whole(kept.documents)
    key = lambda r: (r.doc_stem, r.page, r.trash_type)
    assert sorted(lazy.detections.collect(), key=key) == sorted(kept.detections.collect(), key=key)


def test_stats(spark, docs):
    md = docs({"d": "# d\n\n---\n## Page 1\nx\n## Page 12 and more\n## Page x", "e": "nothing"})
    none = spark.createDataFrame([], "doc_stem string, page int")
    cat = spark.createDataFrame([("d", 1), ("d", 2)], "doc_stem string, page int")
    rows = {r.doc_stem: r for r in documents.document_stats(md, cat, none).collect()}
    assert (rows["d"].page_sections, rows["d"].last_page, rows["d"].images, rows["d"].detections) == (2, 12, 2, 0)
    assert rows["e"].page_sections == 0 and rows["e"].last_page == 0


def test_purge(spark, docs):
    md = docs({"a": "1", "b": "2"})
    left = documents.purge_documents({"m": md, "n": md}, md.where("doc_stem = 'a'"))
    assert all([r.doc_stem for r in t.collect()] == ["b"] for t in left.values())


def test_header_rules(pages):
    lines = boilerplate.headers_footers(
        pages(
            {
                "two": ["H\nx", "H\ny"],
                "five": ["H\n1", "H\n2", " H \n3", "4", "5"],
                "low": ["H\n1", "H\n2", "3", "4", "5"],
                "slots": ["\n\n\nH\nx"] * 3,
                "long": ["ก" * 67 + "\nx\ny\nz\nw"] * 3,
                "repeat": ["R\nR\nR", "x", "y", "z", "w"],
            }
        )
    )
    got = {(r.doc_stem, r.edge, r.line) for r in lines.collect()}
    assert ("five", "header", "H") in got and ("five", "footer", "H") in got
    assert not any(stem in ("two", "low") for stem, _, _ in got)
    assert {e for s, e, _ in got if s == "slots"} == {"footer"}
    assert ("long", "header", "ก" * 67) not in got and ("long", "header", "x") in got
    assert ("repeat", "header", "R") in got


def test_strip(spark, pages):
    table = pages({"a": ["H\r\n body \nmid\n H \nend\n"], "b": [" H \n x\r\n"]})
    hf = spark.createDataFrame([("a", "header", "H", 3, 3)], "doc_stem string, edge string, line string, n long, pages long")
    got = {r.doc_stem: r.text for r in boilerplate.strip_headers_footers(table, hf).collect()}
    assert got == {"a": "body \nmid\nend", "b": " H \n x\r\n"}
