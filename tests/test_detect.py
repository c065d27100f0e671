import pytest
from quire.functions import fixed
from quire.operators import boilerplate, detect


def found(pages, detector, text):
    return [(r.page, r.trash_type, r.confidence, r.reason, r.preview) for r in detector(pages({"d": [text]})).collect()]


BLANK_THAI = fixed.BLANK_MARKER_EXACT


@pytest.mark.parametrize(
    "text, confidence, reason",
    [
        ("   ", 0.80, "Nearly blank page (0 chars)"),
        ("This page intentionally left blank", 0.95, "Explicit blank page marker found"),
        ("Intentionally BLANK " + "x" * 90, 0.95, "Explicit blank page marker found"),
        (BLANK_THAI, 0.95, "Explicit blank page marker found"),
        ("x" * 49, 0.80, "Nearly blank page (49 chars)"),
        ("ก" * 16, 0.80, "Nearly blank page (48 chars)"),
    ],
)
def test_blank(pages, text, confidence, reason):
    [row] = found(pages, detect.detect_blank, text)
    assert row[:4] == (1, "blank_page", confidence, reason)


@pytest.mark.parametrize("text", ["x" * 50, "ก" * 17])
def test_not_blank(pages, text):
    assert found(pages, detect.detect_blank, text) == []


@pytest.mark.parametrize(
    "text, confidence, reason",
    [
        (fixed.TOC_HEADING_EXACT + "\nPump ........ 4\nValves and seals ... 17\nSpare parts .... 33\n", 0.95,
         "TOC heading keyword found with 3 dot-leader lines"),
        ("Table of CONTENTS\na ... 1", 0.90, "TOC heading keyword found"),
        ("a … 1\nb ... 2\nc ... 3 \r\nd ... 4\ne ...5", 0.70, "5 dot-leader lines detected (possible TOC)"),
    ],
)
def test_toc(pages, text, confidence, reason):
    [row] = found(pages, detect.detect_toc, text)
    assert row[:4] == (1, "table_of_contents", confidence, reason)


def test_not_toc(pages):
    assert found(pages, detect.detect_toc, "a ... 1\nb ... 2\nc ... x\nd ... ๕\n.. 5\n...\n12") == []


@pytest.mark.parametrize(
    "text, confidence, reason",
    [
        ("The plates of this atlas are under copyright, and all rights reserved by its printer.", 0.85,
         "Multiple boilerplate keywords: copyright, all rights reserved"),
        ("สงวนลิขสิทธิ์", 0.85, "Multiple boilerplate keywords: ลิขสิทธิ์, สงวนลิขสิทธิ์"),
        ("CONFIDENTIAL", 0.65, 'Boilerplate keyword "confidential" on short page (12 chars)'),
    ],
)
def test_boilerplate(pages, text, confidence, reason):
    [row] = found(pages, detect.detect_boilerplate, text)
    assert row[:4] == (1, "boilerplate", confidence, reason)


def test_one_keyword_on_long_page(pages):
    assert found(pages, detect.detect_boilerplate, "Copyright 2024. " + "x" * 600) == []
    assert found(pages, detect.detect_boilerplate, "copyright " + "ก" * 164) == []


def test_normal_text(pages):
    text = "Turn the left valve by a quarter and wait until the needle rests between both marks before you go on."
    assert found(pages, detect.detect_trash, text) == []


def test_combined(pages):
    table = pages({"d": [
        "Grease the bearings twice a year, in spring and before the first frost of autumn.",
        "\t\n",
        "Bearings ... 3\nFrost ... 8\n" + fixed.TOC_HEADING_EXACT + "\nGrease ... 11",
    ]})
    assert sorted((r.page, r.trash_type) for r in detect.detect_trash(table).collect()) == [
        (2, "blank_page"), (3, "table_of_contents")]


def test_preview_is_cut_by_bytes(pages):
    [row] = found(pages, detect.detect_toc, "\n contents " + "ก" * 100)
    assert row[4] == "contents " + "ก" * 63 + "..."


def test_header_footer_row(spark):
    rows = [("d", "footer", "F", 3, 3), ("d", "header", "Zed", 3, 3), ("d", "header", "Abc", 3, 3)]
    hf = spark.createDataFrame(rows, "doc_stem string, edge string, line string, n long, pages long")
    [row] = boilerplate.header_footer_detection(hf).collect()
    assert (row.page, row.trash_type, row.confidence) == (0, "header_footer", 1.0)
    assert row.reason == 'Repeated text stripped from 3 pages: Header: "Abc", Header: "Zed", Footer: "F"'
    assert row.preview == 'Header: "Abc"; Header: "Zed"; Footer: "F"'


def test_filters(spark):
    rows = [("d", 0, "header_footer"), ("d", 1, "header_footer"), ("d", 1, "blank_page"), ("d", 2, "boilerplate")]
    det = spark.createDataFrame(rows, "doc_stem string, page int, trash_type string")
    count = lambda *a, **k: detect.filter_detections(det, *a, **k).count()
    assert count() == 3
    assert count("blank, header_footer") == 2
    assert count(["nonsense"]) == 0
    assert count(review=True) == 2
    removed = spark.createDataFrame([("d", 1), ("d", 1), ("e", 2)], "doc_stem string, page int")
    with_null = det.unionByName(spark.createDataFrame([("d", None, "x")], det.schema))
    assert sorted(r.trash_type for r in detect.remove_detections(with_null, removed).collect()) == [
        "boilerplate", "header_footer", "x"]
    names = {r.trash_type: (r.detections, r.type_name) for r in detect.detection_summary(det).collect()}
    assert names["header_footer"] == (2, "Header/Footer")
