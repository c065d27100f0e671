"""Sinks that commit, stored tables, indexed corpora and kept answers."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from quire import schemas
from quire.operators import answers, markdown
from quire.sources import files, indexed, sinks, staged, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def catalog(spark, stems):
    rows = [(s, 1, 1, f"{s}/x.png", "full_page", 1, 2, f"of {s}", s, "p", "m") for s in stems]
    return spark.createDataFrame(rows, schemas.CATALOG)


def detections(spark, stems):
    return spark.createDataFrame([(s, 1, "boilerplate", 0.5, "r", "p") for s in stems], schemas.DETECTIONS)


def contents(spark, uri):
    back = files.read_results(spark, uri)
    return (
        {r.doc_stem: r.markdown for r in back.documents.collect()},
        sorted(r.doc_stem for r in back.catalog.collect()),
        sorted(r.doc_stem for r in back.detections.collect()),
    )


def test_a_write_that_fails_leaves_what_was_there(spark, docs, tmp_path):
    uri = str(tmp_path / "out")
    sinks.write_results(docs({"a": "first a", "b": "first b"}), catalog(spark, ["a"]), detections(spark, ["a", "b"]), uri)
    before = contents(spark, uri)

    @F.udf("string")
    def breaks(stem, text):
        if stem == "z":
            raise RuntimeError("cannot go on")
        return text

    many = docs({**{f"n{i}": "new" for i in range(50)}, "a": "second a", "z": "z"}).repartition(4)
    with pytest.raises(Exception, match="cannot go on"):
        sinks.write_results(many.withColumn("markdown", breaks("doc_stem", "markdown")), catalog(spark, ["z"]), detections(spark, []), uri)
    assert contents(spark, uri) == before
    assert sinks.write_results(many, catalog(spark, ["z"]), detections(spark, []), uri)["markdown"] == 52
    texts, images, found = contents(spark, uri)
    assert not list((tmp_path / "out" / "_staging").iterdir())
    assert len(texts) == 53 and texts["a"] == "second a" and texts["b"] == "first b"
    assert images == ["z"] and found == ["b"]


def test_a_marked_write_is_finished_later(spark, docs, tmp_path, monkeypatch):
    uri = str(tmp_path / "out")
    sinks.write_results(docs({"a": "first"}), catalog(spark, []), detections(spark, ["a"]), uri)
    # The driver is lost after the mark: nothing is moved, or only the first files are.
    writer = staged._Writer(uri)
    store, base = staged.open_target(uri)
    import pyarrow as pa

    rows = [("markdown", "a", "second", False), ("markdown", "b", "new", False), ("trash", "a", "[]", True), ("trash", "b", "[]", True)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("folder", "doc_stem", "value", "replacing"), r)) for r in rows])
    message = writer.write(iter([batch]))
    assert message.files == 3  # b has no detections to replace
    monkeypatch.setattr(staged, "_publish", lambda *a: None)
    writer.commit([message, None])
    monkeypatch.undo()
    first = staged._read(store, f"{base}/{message.listing}").split("\n")[0].split("\t")
    store.move(f"{base}/{first[0]}", f"{base}/{first[1]}")
    other = staged._Writer(uri)
    other.write(iter([batch]))  # of a write that is still under way
    assert staged.finish(uri) == 1 and staged.finish(uri) == 0
    texts, _, found = contents(spark, uri)
    assert texts == {"a": "second", "b": "new"} and found == []
    assert len(os.listdir(tmp_path / "out" / "_staging")) == 1
    other.abort([None])
    assert staged.finish(uri) == 0 and not os.listdir(tmp_path / "out" / "_staging")


def test_a_write_looks_at_no_other_document(spark, docs, tmp_path, monkeypatch):
    uri = str(tmp_path / "out")
    sinks.write_results(docs({f"d{i}": "x" for i in range(20)}), catalog(spark, []), detections(spark, ["d1"]), uri)
    os.chmod(tmp_path / "out", 0o755)
    times = {p: os.stat(p).st_mtime_ns for p in (tmp_path / "out").rglob("*.txt")}
    sinks.write_results(docs({"d1": "y"}), catalog(spark, []), detections(spark, []), uri)
    changed = {str(p) for p, t in times.items() if os.stat(p).st_mtime_ns != t}
    assert changed and all("doc_stem=d1/" in p for p in changed)


def test_purged_results(spark, docs, tmp_path):
    uri = f"file://{tmp_path}/out"
    sinks.write_results(docs({"a": "x", "b/c%": "y", "v1..2": "z", "..": "w"}), catalog(spark, ["a"]), detections(spark, ["b/c%"]), uri)
    ids = spark.createDataFrame([("b/c%",), ("none",), ("b/c%",), ("v1..2",), ("..",)], "doc_stem string")
    assert sinks.purge_results(ids, uri) == 7
    assert contents(spark, uri) == ({"a": "x"}, ["a"], [])
    assert sinks.purge_results(ids, uri) == 0


def test_purged_jobs(spark, docs, tmp_path):
    uri = str(tmp_path / "out")
    sinks.write_results(docs({"a": "x", "b": "y"}), catalog(spark, ["a"]), detections(spark, ["b"]), uri)
    for stem in ("a", "b"):
        (tmp_path / "out/images" / stem).mkdir(parents=True)
        (tmp_path / "out/images" / stem / "p.png").write_bytes(b"x")
    (tmp_path / "up").mkdir()
    for name in ("j1", "j2"):
        (tmp_path / "up" / f"{name}.pdf").write_bytes(b"x")
    (tmp_path / "secret").mkdir()
    jobs = spark.createDataFrame([("j1", "a.pdf"), ("j9", "none.pdf"), ("../secret", "../../secret"), ("j8", ".pdf")], "id string, filename string")
    assert sinks.purge_jobs(jobs, str(tmp_path / "up"), uri) == {"uploads": 1, "results": 2, "images": 1}
    assert contents(spark, uri) == ({"b": "y"}, [], ["b"])
    assert [p.name for p in (tmp_path / "up").iterdir()] == ["j2.pdf"] and (tmp_path / "secret").exists()
    assert [p.name for p in (tmp_path / "out/images").iterdir()] == ["b"]


SCHEMAS = {"markdown": "doc_stem string, markdown string", "images_metadata": schemas.CATALOG, "trash": schemas.DETECTIONS}


def tables(spark, docs, texts, images=(), found=()):
    return {"markdown": docs(texts), "images_metadata": catalog(spark, images), "trash": detections(spark, found)}


def stems(spark, uri):
    return {n: sorted(r.doc_stem for r in stored.read_stored(spark, uri, n, s).collect()) for n, s in SCHEMAS.items()}


def times(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("part-*")}


def test_stored_documents_are_replaced_and_purged(spark, docs, tmp_path):
    uri, names = str(tmp_path / "s"), [f"d{i}" for i in range(40)]
    stored.save_documents(tables(spark, docs, dict.fromkeys(names, "one"), names[:20], names[::2]), uri, buckets=16)
    before = times(tmp_path / "s")
    stored.save_documents(tables(spark, docs, {"d3": "two", "new": "n"}, ["new"]), uri, buckets=16)
    texts = {r.doc_stem: r.markdown for r in stored.read_stored(spark, uri, "markdown", SCHEMAS["markdown"]).collect()}
    assert texts == {**dict.fromkeys(names, "one"), "d3": "two", "new": "n"}
    assert stems(spark, uri)["images_metadata"] == sorted([*names[:3], *names[4:20], "new"])
    after = times(tmp_path / "s")
    touched = {r[0] for r in docs({"d3": "", "new": ""}).select(stored.bucket_of(buckets=16)).collect()}
    same = lambda p: int(p.split("bucket=")[1].split("/")[0]) not in touched
    assert {p: t for p, t in before.items() if same(p)} == {p: t for p, t in after.items() if same(p)}

    ids = spark.createDataFrame([("d3",), ("d5",), ("d5",), ("none",)], "doc_stem string")
    assert stored.purge_stored(spark, uri, SCHEMAS, ids, buckets=16) == {"markdown": 2, "images_metadata": 1, "trash": 0}
    for name, left in stems(spark, uri).items():
        assert not {"d3", "d5"} & set(left), name
    assert len(stems(spark, uri)["markdown"]) == 39
    touched = {r[0] for r in ids.select(stored.bucket_of(buckets=16)).collect()}
    kept = {p: t for p, t in after.items() if same(p)}
    assert kept and kept == {p: t for p, t in times(tmp_path / "s").items() if same(p)}
    assert stored.purge_stored(spark, uri, SCHEMAS, ids, buckets=16) == {"markdown": 0, "images_metadata": 0, "trash": 0}


def test_a_partition_that_becomes_empty(spark, docs, tmp_path):
    uri = str(tmp_path / "s")
    stored.save_documents({"markdown": docs({"a": "x"})}, uri, buckets=4)
    only = {"markdown": SCHEMAS["markdown"]}
    assert stored.purge_stored(spark, uri, only, spark.createDataFrame([("a",)], "doc_stem string"), buckets=4) == {"markdown": 1}
    assert stored.read_stored(spark, uri, "markdown", SCHEMAS["markdown"]).count() == 0


TEXTS = {
    **{f"p{i}": f"plain text number {i} about Alpha\nand more" for i in range(60)},
    "x": "The Needle stands here, needle again; NEEDLE!", "y": "Größe ÄRGER ärger straße", "z": "", "k": "Kelvin K k",
}


@pytest.mark.parametrize("query", ["needle", "Needle", "number 7", "ärger", "Größe", "a", "K", "zz top", "", "text number", "straße"])
@pytest.mark.parametrize("case", [True, False])
def test_indexed_search_finds_the_same(spark, docs, tmp_path_factory, query, case):
    uri = str(tmp_path_factory.getbasetemp() / "corpus")
    if not os.path.exists(uri):
        indexed.index_corpus(docs(TEXTS), uri, blocks=16)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(indexed.search_indexed(spark, uri, query, case)) == rows(markdown.search_corpus(docs(TEXTS), query, case))
    blocks = indexed.candidate_blocks(spark, uri, query, case)
    if query == "needle":
        assert blocks.count() == 1
    if query == "zz top":
        assert blocks.count() == 0


def test_other_blocks_are_not_read(spark, docs, tmp_path):
    uri = str(tmp_path / "corpus")
    indexed.index_corpus(docs(TEXTS), uri, blocks=16)
    [wanted] = [r.block for r in indexed.candidate_blocks(spark, uri, "NEEDLE").collect()]
    for path in (tmp_path / "corpus/docs").rglob("part-*"):
        if f"block={wanted}/" not in str(path):
            path.write_bytes(b"not a table")
            crc = path.with_name(f".{path.name}.crc")
            if crc.exists():
                crc.unlink()
    assert indexed.search_indexed(spark, uri, "NEEDLE").count() == 3
    with pytest.raises(Exception, match="[Pp]arquet|FAILED_READ_FILE"):
        indexed.search_indexed(spark, uri, "a").count()


def test_indexed_replace_writes_the_blocks_that_match(spark, docs, tmp_path):
    uri = str(tmp_path / "corpus")
    indexed.index_corpus(docs(TEXTS), uri, blocks=16)
    before = times(tmp_path / "corpus/docs")
    indexed.replace_indexed(spark, uri, "needle", "$1 pin")
    want = {r.doc_stem: r.markdown for r in markdown.replace_corpus(docs(TEXTS), "needle", "$1 pin").collect()}
    assert {r.doc_stem: r.markdown for r in indexed.read_indexed(spark, uri).collect()} == want
    after = times(tmp_path / "corpus/docs")
    assert len(set(before) - set(after)) == 1
    assert indexed.search_indexed(spark, uri, "$1 pin").count() == 3 and indexed.search_indexed(spark, uri, "needle").count() == 0
    indexed.replace_indexed(spark, uri, "not there at all", "x")
    assert times(tmp_path / "corpus/docs") == after


REQUEST = (
    "doc_stem string, page_num int, kind string, index int, width int, height int, hint string, "
    "fallback string, content binary, image_ref string"
)


class Counting:
    """Notes every call in a file."""

    def __init__(self, path):
        self.path = path

    def __call__(self, row):
        with open(self.path, "a") as f:
            f.write("x")
        if row["content"] == b"dark":
            raise RuntimeError("too dark")
        return f"{row['prompt']}:{bytes(row['content'] or b'').decode() or row['image_ref']}"


def test_answers_are_kept_by_content(spark, tmp_path):
    rows = [(f"d{i % 7}", i, "img", 1, 5, 6, None, None, b"logo", f"r{i}") for i in range(40)]
    rows += [("e", 0, "img", 1, 5, 6, None, None, b"other", "s"), ("e", 1, "full", None, None, None, None, None, b"logo", "t"),
             ("e", 2, "img", 1, 5, 6, None, None, b"dark", "u"), ("e", 3, "img", 1, 5, 6, None, None, b"dark", "v"),
             ("f", 0, "hq", None, None, None, "HINT", "page", b"logo", "w"), ("f", 1, "img", 1, 1, 1, None, None, None, "n1"),
             ("f", 2, "img", 1, 1, 1, None, None, None, "n2"), ("f", 2, "img", 1, 1, 1, None, None, None, "n2")]
    requests = spark.createDataFrame(rows, REQUEST).repartition(3)
    calls, store = str(tmp_path / "calls"), str(tmp_path / "store")
    prompts = {"img": "look", "full": "read", "hq": "see", "hq_hint": "see {hint_text}"}

    def run(model="m1", more=prompts):
        before = os.path.getsize(calls) if os.path.exists(calls) else 0
        found = answers.describe_once(requests, Counting(calls), store, model, 2, 0.0, more).collect()
        return found, os.path.getsize(calls) - before

    found, made = run()
    assert made == 8  # logo, other, logo as full page, dark twice, logo with its hint, two without bytes
    assert len(found) == len(rows)
    by = {r.image_ref: r for r in found}
    assert by["r5"].description == "look:logo" and by["t"].description == "read:logo" and by["w"].description == "see HINT:logo"
    assert by["u"].error and by["v"].error and by["u"].description is None
    assert by["n1"].description == "look:n1" and sum(r.image_ref == "n2" for r in found) == 2
    again, made = run()
    assert made == 2  # only the one that failed, tried twice
    key = lambda r: (r.image_ref, r.description, r.error)
    assert sorted(map(str, map(key, again))) == sorted(map(str, map(key, found)))
    assert {r.attempts for r in again if not r.error} == {0}
    assert run("m2")[1] == 8  # another model
    assert run(more={**prompts, "full": "write"})[1] == 3  # another prompt for whole pages
    assert "content" not in found[0].asDict()


def test_saving_makes_each_table_once_beside_its_list(spark, docs, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    tables = {"markdown": docs({"a": "x", "b": "y", "c": "z"}), "trash": detections(spark, ["a", "b"]).mapInArrow(count, schemas.DETECTIONS)}
    for _ in range(2):
        made.value = 0
        stored.save_documents(tables, str(tmp_path / "s"), buckets=70)
        assert made.value == 4  # for the list and for the write
    stored.save_documents({"trash": detections(spark, ["c"])}, str(tmp_path / "s"), docs({"b": "", "c": ""}), buckets=70)
    assert [r.doc_stem for r in stored.read_stored(spark, str(tmp_path / "s"), "trash", schemas.DETECTIONS).orderBy("doc_stem").collect()] == ["a", "c"]


def test_a_large_partition_is_written_by_several_tasks(spark, docs, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "20000")
    try:
        many = spark.range(2000, numPartitions=8).select(F.concat(F.lit("d"), "id").alias("doc_stem"), F.sha2(F.col("id").cast("string"), 512).alias("markdown"))
        stored.save_documents({"markdown": many}, str(tmp_path / "s"), buckets=1)
    finally:
        spark.conf.set(size, before)
    assert len(list((tmp_path / "s" / "markdown" / "bucket=0").glob("*.parquet"))) > 1
    back = stored.read_stored(spark, str(tmp_path / "s"), "markdown", "doc_stem string, markdown string")
    assert back.distinct().count() == back.count() == 2000


def test_indexing_makes_the_documents_once(spark, docs, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    given = docs({f"d{n}": f"text {n} of the Acme manual" for n in range(9)}).mapInArrow(count, "doc_stem string, markdown string")
    base = str(tmp_path / "c")
    indexed.index_corpus(given, base, blocks=4)
    assert made.value == 9
    indexed.replace_indexed(spark, base, "acme manual", "guide")
    back = {r.doc_stem: r.markdown for r in indexed.read_indexed(spark, base).collect()}
    assert back == {f"d{n}": f"text {n} of the guide" for n in range(9)}
    assert indexed.search_indexed(spark, base, "GUIDE").count() == 9
