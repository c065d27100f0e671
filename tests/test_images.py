import pytest
from pyspark.sql import functions as F
from quire import schemas
from quire.operators import images


def html(docs, text, base="http://host", **k):
    return images.image_groups_html(docs({"d": text}), base, **k).first().markdown


WRAP = '<div style="display:flex;flex-wrap:wrap;gap:8px;margin:8px 0;">'


def img(path, width):
    return f'<img src="http://host/{path}" style="max-width:{width};border-radius:8px;margin:8px 0;">'


@pytest.mark.parametrize(
    "text, want",
    [
        ("[IMAGE:d/a.png]\nSome text.", img("d/a.png", "100%") + "\nSome text."),
        ("[IMAGE:a.png]\n [IMAGE:b.png] \nText\n",
         "\n".join([WRAP, img("a.png", "calc(50% - 4px)"), img("b.png", "calc(50% - 4px)"), "</div>", "Text", ""])),
        ("[IMAGE:a.png]\n[IMAGE:b.png]\n[IMAGE:c.png]",
         "\n".join([WRAP, *[img(f"{c}.png", "calc(33% - 6px)") for c in "abc"], "</div>"])),
        ("\n".join(f"[IMAGE:{c}]" for c in "abcde"),
         "\n".join([WRAP, *[img(c, "calc(25% - 6px)") for c in "abcde"], "</div>"])),
        ("[IMAGE:a]\n\n[IMAGE:b]", img("a", "100%") + "\n\n" + img("b", "100%")),
        ("Two plain lines\nwithout any tag", "Two plain lines\nwithout any tag"),
        ("[IMAGE:]", "[IMAGE:]"),
        ("see [IMAGE:a] here", "see [IMAGE:a] here"),
        ("[IMAGE:a]b]", img("a]b", "100%")),
        ("", ""),
    ],
)
def test_html(docs, text, want):
    assert html(docs, text) == want
    assert html(docs, text, "http://host/") == want


def test_links(docs):
    text = "x [IMAGE:d/a.png] y\n[IMAGE:b.png]\n[IMAGE:]"
    assert html(docs, text, "/im$1", style="md") == "x ![a.png](/im$1/d/a.png) y\n![b.png](/im$1/b.png)\n[IMAGE:]"


def objects(spark, rows):
    full = [("d", p, i, k, 100.0, 100.0, l, r, t, b, w, h) for p, i, k, l, r, t, b, w, h in rows]
    return spark.createDataFrame(full, schemas.PAGE_OBJECTS)


def test_coverage(spark):
    table = objects(spark, [
        (0, 1, "image", 0.0, 50.0, 50.0, 0.0, 1, 1), (0, 2, "image", 50.0, 0.0, 0.0, 50.0, 1, 1),
        (0, 3, "text", 0.0, 90.0, 90.0, 0.0, 1, 1), (1, 1, "text", 0.0, 1.0, 1.0, 0.0, 1, 1),
        (2, 1, "image", 0.0, 100.0, 300.0, 0.0, 1, 1)])
    empty = table.where("page_num = 2").withColumns({"page_num": F.lit(3), "page_w": F.lit(0.0)})
    got = {r.page_num: r.coverage for r in images.image_coverage(table.unionByName(empty)).collect()}
    assert got == {0: 0.5, 1: 0.0, 2: 1.0, 3: 0.0}


@pytest.mark.parametrize("width", [1, 3, 1024])
def test_large_images_are_numbered_in_order(spark, width):
    sizes = [(100, 100), (99, 100), (100, 99), (500, 100), (100, 100), (100, 700), (20, 20), (100, 100)]
    rows = [(0, i, "image", 0.0, 1.0, 1.0, 0.0, w, h) for i, (w, h) in enumerate(sizes)]
    rows.append((0, 99, "text", 0.0, 1.0, 1.0, 0.0, 300, 300))
    got = images.keep_large_images(objects(spark, rows), block_width=width).orderBy("index").collect()
    assert [(r["index"], r.obj_idx) for r in got] == [(1, 0), (2, 3), (3, 4), (4, 5), (5, 7)]


def test_catalog(spark):
    described = spark.createDataFrame(
        [("d", 0, "hq", None, None, None, "ก" * 100), ("d", 1, "img", 12, 640, 480, "pic"),
         ("d", 1233, "table", None, None, None, "tab"), ("d", 2, "full", None, None, None, "x" * 300)],
        "doc_stem string, page_num int, kind string, index int, width int, height int, description string")
    got = {r.image_file: r for r in images.catalog_rows(described, "ollama", "m").collect()}
    assert set(got) == {"d/d_page_001_hq.png", "d/d_page_002_img12.png", "d/d_page_1234_table.png", "d/d_page_003_full.png"}
    assert got["d/d_page_001_hq.png"].description == "ก" * 66
    assert len(got["d/d_page_003_full.png"].description) == 300
    row = got["d/d_page_002_img12.png"]
    assert (row.page, row["index"], row.type, row.width, row.height) == (2, 12, "extracted_image", 640, 480)
    assert (row.source_doc, row.provider, row.model) == ("d", "ollama", "m")
    assert got["d/d_page_1234_table.png"].type == "table_region"
