import random

import expected
import pytest
from pyspark.sql import functions as F
from quire.operators import documents, images, markdown as md
from quire.operators.keys import whole_documents
from quire.plans import pipelines
from quire.sources import sinks
from quire.sources.files import read_results

PIECES = ["## Page 1\n", "## Page 2\n", " ## Page 3 \r\n", "## Page +4\n", "## Page x\n", "---\n", "\n", "text\n", "a",
          "[IMAGE:p.png]\n", "[IMAGE:q.png] tail\n", "see [IMAGE:p.png]\n", "# h\n", "  \n", "line\r\n", "[IMAGE:]\n"]


def random_docs(seed, count=1500, longest=16):
    rng = random.Random(seed)
    return {f"d{i}": "".join(rng.choices(PIECES, k=rng.randint(0, longest))) for i in range(count)}


def by_stem(df):
    return {r.doc_stem: r.markdown for r in df.collect()}


def sections_of(docs, text):
    rows = md.split_sections(docs({"d": text})).orderBy("section_no").collect()
    return [(r.page_number, r.header, r.content, r.raw_content) for r in rows]


def test_sections(docs):
    text = "# T\n\n---\n## Page 1\n---\n\n body \n## Page 2 tail\nx\n ## Page 3\n## Page x"
    assert sections_of(docs, text) == [
        (0, "", "# T\n\n---", "# T\n\n---"),
        (1, "## Page 1", "## Page 1\n---\n\n body ", "body"),
        (2, "## Page 2 tail", "## Page 2 tail\nx\n ## Page 3\n## Page x", "x\n ## Page 3\n## Page x"),
    ]
    assert sections_of(docs, "## Page 7\nx") == [(7, "## Page 7", "## Page 7\nx", "x")]
    assert sections_of(docs, "## Page 7") == [(7, "## Page 7", "## Page 7", "")]
    assert sections_of(docs, "") == [(0, "", "", "")]


def test_sections_join_to_the_document(docs):
    texts = random_docs(3, 400)
    parts = {}
    for r in md.split_sections(docs(texts)).orderBy("doc_stem", "section_no").collect():
        parts.setdefault(r.doc_stem, []).append(r.content)
    assert {k: "\n".join(v) for k, v in parts.items()} == texts


def test_labels(spark, docs):
    det = spark.createDataFrame(
        [("d", 1, "blank_page"), ("d", 1, "table_of_contents"), ("d", 0, "header_footer"), ("d", 2, "other")],
        "doc_stem string, page int, trash_type string",
    )
    sections = md.split_sections(docs({"d": "h\n## Page 1\n## Page 2\n## Page 3"}))
    got = {r.page_number: r.label for r in md.label_sections(sections, det).collect()}
    assert got == {0: "Header/Footer", 1: "Blank", 2: "other", 3: None}


def test_remove_pages_random(spark, docs):
    texts = random_docs(4)
    rng = random.Random(5)
    gone = {stem: set(rng.sample([1, 2, 3, 4, 9], k=rng.randint(0, 3))) for stem in texts}
    rows = [(s, p) for s, pages in gone.items() for p in pages for _ in range(2)]
    removals = spark.createDataFrame(rows, "doc_stem string, page int")
    got = by_stem(md.remove_pages(docs(texts), removals))
    want = {}
    for stem, text in texts.items():
        # A plus sign before the number is allowed.
        plain = text.replace("## Page +4", "## Page 4")
        want[stem] = expected.without_pages(plain, gone[stem]) if text else ""
    assert {s: t.replace("## Page +4", "## Page 4") for s, t in got.items()} == want


def test_remove_image_blocks_random(spark, docs):
    texts = random_docs(6)
    rng = random.Random(7)
    gone = {stem: set(rng.sample(["p.png", "q.png", "other.png", ""], k=rng.randint(0, 3))) for stem in texts}
    rows = [(s, f) for s, files in gone.items() for f in files]
    deleted = spark.createDataFrame(rows, "doc_stem string, image_file string")
    got = by_stem(images.remove_image_blocks(docs(texts), deleted))
    want = {s: expected.without_images(t, gone[s]) if t else "" for s, t in texts.items()}
    assert got == want


def test_remove_image_blocks_keeps_the_rest(spark, docs):
    text = ("# Page 1\n\n[IMAGE:photo1.png]\nThis is a photo of something\n\n[IMAGE:photo2.png]\nAnother description here\n\n"
            "Some regular text\n\n[IMAGE:photo3.png]\nThird image description\n")
    deleted = spark.createDataFrame([("d", "photo1.png"), ("d", "photo3.png")], "doc_stem string, image_file string")
    got = by_stem(images.remove_image_blocks(docs({"d": text}), deleted))["d"]
    assert got == "# Page 1\n\n[IMAGE:photo2.png]\nAnother description here\n\nSome regular text\n"


def edit(spark, docs, text, edits):
    table = spark.createDataFrame(
        [("d", *e) for e in edits], "doc_stem string, page int, action string, content string, new_pos int"
    )
    return by_stem(md.apply_section_edits(docs({"d": text}), table))["d"]


def test_section_edits(spark, docs):
    text = "head\n## Page 1\na\n## Page 2\nb\n## Page 3\nc"
    assert edit(spark, docs, text, [(2, "delete", None, None)]) == "head\n## Page 1\na\n## Page 3\nc"
    assert edit(spark, docs, text, [(2, "replace", "new", None)]) == (
        "head\n## Page 1\na\n## Page 2\n---\nnew\n## Page 3\nc")
    assert edit(spark, docs, text, [(0, "replace", "HEAD", None)]).startswith("HEAD\n## Page 1")
    assert edit(spark, docs, text, [(9, "delete", None, None)]) == text
    order = lambda pos: edit(spark, docs, text, [(2, "move", None, pos)])
    assert order(3) == "head\n## Page 1\na\n## Page 3\nc\n## Page 2\nb"
    assert order(1) == "head\n## Page 2\nb\n## Page 1\na\n## Page 3\nc"
    assert order(0) == "## Page 2\nb\nhead\n## Page 1\na\n## Page 3\nc"
    assert order(2) == text


def matches(docs, text, query, **k):
    return [(r.offset, r.length) for r in md.search_corpus(docs({"d": text}), query, **k).orderBy("match_no").collect()]


def test_search(docs):
    assert matches(docs, "Aa aA é a", "a") == [(0, 1), (1, 1), (3, 1), (4, 1), (8, 1)]
    assert matches(docs, "aaa", "aa") == [(0, 2)]
    assert matches(docs, "x.y x+y", "x.y", case_sensitive=True) == [(0, 3)]
    assert matches(docs, "É é", "é") == [(0, 1), (2, 1)]
    assert matches(docs, "\u212a \u017f", "k") == [] and matches(docs, "\u212a \u017f", "s") == []
    assert matches(docs, "abc", "") == []
    assert matches(docs, "a\nb", "a\nb") == [(0, 3)]
    assert md.count_matches(docs({"d": "aXa"}), "A").first().matches == 2


def test_replace(docs):
    swap = lambda *a, **k: by_stem(md.replace_corpus(docs({"d": "a.b A.B axb $"}), *a, **k))["d"]
    assert swap("a.b", "$1\\") == "$1\\ $1\\ axb $"
    assert swap("a.b", "c", case_sensitive=True) == "c A.B axb $"
    assert swap("$", "€") == "a.b A.B axb €"
    assert swap("", "x") == "a.b A.B axb $"


def test_strip_trash(spark, docs):
    det = spark.createDataFrame(
        [("d", 1, "blank_page"), ("d", 2, "boilerplate"), ("d", 0, "header_footer")],
        "doc_stem string, page int, trash_type string",
    )
    text = "h\n## Page 1\na\n## Page 2\nb\n"
    both = by_stem(pipelines.strip_trash(docs({"d": text, "e": "as\r\nit is"}), det))
    assert both == {"d": "h\n", "e": "as\r\nit is"}
    assert by_stem(pipelines.strip_trash(docs({"d": text}), det, "blank"))["d"] == "h\n## Page 2\nb\n"


def test_delete_images(spark, docs):
    cat = spark.createDataFrame([("d", "a.png"), ("d", "b.png"), ("e", "a.png")], "doc_stem string, image_file string")
    asked = [("d", "a.png"), ("d", "a.png"), ("d", "gone.png"), ("d", "../b.png"), ("d", "x\\b.png")]
    requests = spark.createDataFrame(asked, cat.schema)
    done = pipelines.delete_images(docs({"d": "[IMAGE:a.png]\nx\n\n[IMAGE:b.png]\n", "e": "[IMAGE:a.png]\n"}), cat, requests)
    assert by_stem(done.documents) == {"d": "[IMAGE:b.png]", "e": "[IMAGE:a.png]\n"}
    assert sorted((r.doc_stem, r.image_file) for r in done.catalog.collect()) == [("d", "b.png"), ("e", "a.png")]
    row = done.counts.first()
    assert (row.deleted, row.failed, row.image_count) == (3, 2, 0)


def test_results_do_not_depend_on_the_block_size(spark, pages, tmp_path):
    texts = [f"page {i} alpha\n[IMAGE:d/{i}.png]\nabout {i}\n" for i in range(9)]
    table = pages({"d": texts, "e": ["alpha alone"]})
    removals = spark.createDataFrame([("d", 2), ("d", 8)], "doc_stem string, page int")
    deleted = spark.createDataFrame([("d", "d/3.png"), ("d", "d/8.png")], "doc_stem string, image_file string")
    edits = spark.createDataFrame(
        [("d", 7, "move", None, 2, 1), ("d", 3, "replace", "new", None, 1), ("d", 5, "delete", None, None, 1)],
        "doc_stem string, page int, action string, content string, new_pos int, seq int",
    )
    jobs = spark.createDataFrame([("1", "d.pdf", "completed")], "id string, filename string, status string")
    none = spark.createDataFrame([], "doc_stem string, page int, image_file string")

    def joined(df):
        return sorted(map(tuple, whole_documents(df).select("doc_stem", "markdown").collect()))

    def everything(size):
        docs = pipelines.text_only_pipeline(table, block_pages=size).documents
        out = f"file://{tmp_path}/{size}"
        sinks.write_results(docs, none, none, out)
        back = read_results(spark, out).documents
        rows = [
            md.split_sections(docs), md.search_corpus(docs, "3\n\n\n---\n## Page 5", True), md.search_corpus(docs, "alpha"),
            md.remove_pages(docs, removals), md.apply_section_edits(docs, edits), md.replace_corpus(docs, "---\n## page", "P"),
            md.count_matches(docs, "page"), documents.results_view(jobs, docs, none, none), sinks.markdown_files(docs),
            sinks.publish_payloads(docs, "flowise", store_id="s"), back.select("doc_stem", "markdown"),
            documents.document_stats(docs, none, none),
        ]
        tables = [sorted(map(str, df.collect())) for df in rows]
        return tables + [joined(images.remove_image_blocks(docs, deleted)), joined(images.image_groups_html(docs, "b"))]

    whole = everything(512)
    assert all(whole) and len(whole[2]) == 10
    for size in (1, 2, 7):
        assert everything(size) == whole, size


def test_last_edit_of_a_page_wins(spark, docs):
    text = "# d\n## Page 1\none\n## Page 2\ntwo\n## Page 3\nthree"
    edits = spark.createDataFrame(
        [("d", 1, "replace", "zzz first", None, 1), ("d", 1, "replace", "aaa last", None, 2),
         ("d", 3, "move", None, 2, 1), ("d", 3, "move", None, 1, 2), ("d", 2, "delete", None, None, 1), ("d", 2, "replace", "x", None, 2)],
        "doc_stem string, page int, action string, content string, new_pos int, seq int",
    )
    got = md.apply_section_edits(docs({"d": text}), edits).collect()[0].markdown
    assert got == "# d\n## Page 3\nthree\n## Page 1\n---\naaa last"


@pytest.mark.parametrize("number,header", [(3_000_000_000, True), (4_294_967_295, True), (4_294_967_296, False), (10**10, False)])
def test_page_numbers_of_ten_digits(spark, docs, number, header):
    text = f"head\n## Page {number}\nbody\n"
    wanted = spark.createDataFrame([("d", number)], "doc_stem string, page bigint")
    got = md.remove_pages(docs({"d": text}), wanted).collect()[0].markdown
    assert got == ("head\n" if header else text)


def test_trash_is_stripped_of_texts_made_once(spark):
    page = F.concat(F.lit("# t\n\n---\n## Page 1\none\n\n---\n## Page "), (F.col("id") + 2).cast("string"), F.lit("\r\ntwo"))
    docs = spark.range(33).select(F.concat(F.lit("d"), "id").alias("doc_stem"), page.alias("markdown"))
    det = spark.createDataFrame([("d0", 2, "blank_page"), ("d1", 9, "blank_page"), ("d2", 0, "header_footer"), ("d3", 1, "boilerplate"), ("d3", 5, "blank_page")],
                                "doc_stem string, page int, trash_type string")
    stripped = pipelines.strip_trash(docs, det)
    assert stripped._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 33") == 1  # twice before
    got = {r.doc_stem: r.markdown for r in stripped.collect()}
    assert len(got) == 33 and got["d0"] == "# t\n\n---\n## Page 1\none\n\n---\n"
    assert got["d1"] == "# t\n\n---\n## Page 1\none\n\n---\n## Page 3\ntwo\n"  # listed, but for a page that it does not have
    assert got["d2"] == "# t\n\n---\n## Page 1\none\n\n---\n## Page 4\r\ntwo" and got["d3"] == "# t\n\n---\n"


@pytest.mark.parametrize("text", ["", "\n", "\n\n", "## Page 2", "## Page 2\n", "\n## Page 2", "a\r\n## Page 2\r\n\r\n", "## Page 1\n## Page 2\n## Page 3"])
@pytest.mark.parametrize("own", [False, True])
def test_ends_of_texts_around_removed_pages(spark, docs, text, own):
    gone = spark.createDataFrame([("d", 2)], "doc_stem string, page int")
    got = md.remove_pages(docs({"d": text}), gone, own_pages=own).first().markdown
    lines = text.replace("\r\n", "\n").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    left, keep = "", True
    for line in lines:
        keep = line != "## Page 2" if line.startswith("## Page ") else keep
        left += line + "\n" if keep else ""
    assert got == left
