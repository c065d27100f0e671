import os
import sys

import pytest
from pyspark import TaskContext, cloudpickle
from quire.operators import enrich, extract
from quire.sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Lines:
    """A page a line; some cannot be read, and one file breaks off."""

    def count(self, content):
        if content == b"broken":
            raise ValueError("no such format")
        return content.count(b"\n") + 1

    def read(self, content, first, stop):
        for n, line in enumerate(content.decode().split("\n")[first:stop], first):
            if line == "raise":
                raise ValueError(f"cannot read {n}")
            if line == "end":
                return
            yield ValueError(f"bad {n}") if line == "bad" else line


def long_text(n):
    return "\n".join("raise" if i % 17 == 5 else "bad" if i % 19 == 7 else f"page {i}" for i in range(n))


@pytest.fixture
def some(spark):
    rows = [("long", long_text(100).encode(), None), ("short", b"one\nraise\nthree", None), ("b", b"broken", None),
            ("gone", None, "too large"), ("none", None, None), ("cut", b"a\nend\nb\nc", None), ("short", b"again", None), ("empty", b"", None)]
    return spark.createDataFrame(rows, "doc_stem string, content binary, error string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("span", [(0, None), (3, 40), (90, 300)])
def test_rows_do_not_depend_on_the_ranges(some, span):
    want = rows(extract.pages_in_ranges(some, Lines(), *span, range_pages=1000))
    for size in (1, 7, 64):
        assert rows(extract.pages_in_ranges(some, Lines(), *span, range_pages=size, tasks=3)) == want
    found = {(s, n): (t, e) for s, n, t, e in want if s == "long"}
    first, stop = span[0], min(100, span[1] or 100)
    assert sorted(n for _, n in found) == list(range(first, stop))
    for (_, n), value in found.items():
        line = long_text(100).split("\n")[n]
        assert value == {"raise": ("", f"cannot read {n}"), "bad": ("", f"bad {n}")}.get(line, (line, None))


def test_failed_files_and_missing_pages(some):
    got = rows(extract.pages_in_ranges(some, Lines(), range_pages=2))
    of = lambda stem: [r[1:] for r in got if r[0] == stem]
    assert of("b") == [(0, "", "no such format")] and of("gone") == [(0, "", "too large")] and of("none") == [(0, "", "no content")]
    assert of("cut") == [(0, "a", None)] + [(1, "", "the reader gave no such page")] + [(2, "b", None), (3, "c", None)]
    assert of("short") == [(0, "again", None), (0, "one", None), (1, "", "cannot read 1"), (2, "three", None)]
    assert of("empty") == [(0, "", None)]


class Where(Lines):
    def read(self, content, first, stop):
        for n in range(first, stop):
            yield f"{n} in {TaskContext.get().partitionId()}"


def test_a_long_file_runs_in_many_tasks(spark, tmp_path):
    (tmp_path / "long.pdf").write_bytes(b"\n" * 4999)
    (tmp_path / "other.pdf").write_bytes(b"\n" * 9)
    listed = files.list_files(spark, str(tmp_path))
    assert "content" not in listed.columns
    pages = extract.pages_in_ranges(listed, Where(), range_pages=100, opener=extract.open_file, tasks=8)
    texts = [(r.page_num, r.text.split(" in ")) for r in pages.where("doc_stem = 'long'").collect()]
    assert sorted(n for n, _ in texts) == list(range(5000)) and all(t[0] == str(n) for n, t in texts)
    per_task = {t: sum(1 for _, x in texts if x[1] == t) for t in {x[1] for _, x in texts}}
    assert len(per_task) == 8 and max(per_task.values()) <= 900
    assert pages.where("doc_stem = 'other'").count() == 10


def test_a_file_that_is_gone_when_its_range_is_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"\n" * 4)
    pages = extract.pages_in_ranges(files.list_files(spark, str(tmp_path)), Lines(), range_pages=2, opener=extract.open_file)
    (tmp_path / "a.pdf").unlink()  # counted before
    got = pages.collect()
    assert sorted(r.page_num for r in got) == list(range(5)) and all(r.error for r in got)


def test_files_too_large_for_a_row_are_error_rows(spark, tmp_path):
    (tmp_path / "small.pdf").write_bytes(b"one page")
    with open(tmp_path / "large.pdf", "wb") as f:
        f.truncate(2_200_000_000)  # sparse
    found = files.ingest_files(spark, str(tmp_path))
    got = {r.doc_stem: (r.text, r.error) for r in enrich.pages_from_documents(found, lambda c: [c.decode()]).collect()}
    assert got["small"] == ("one page", None) and "2200000000 bytes" in got["large"][1]


def test_small_files_share_tasks(spark, tmp_path):
    for n in range(300):
        (tmp_path / f"f{n}.pdf").write_bytes(b"page")
    before = spark.conf.get(files._OPEN_COST)
    try:
        spark.conf.unset(files._OPEN_COST)
        listed = files.list_files(spark, str(tmp_path))
        assert listed.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1  # 32 files a task before
        assert listed.count() == 300
        spark.conf.set(files._OPEN_COST, "1m")  # a caller's own
        files.list_files(spark, str(tmp_path))
        assert spark.conf.get(files._OPEN_COST) == "1m"
    finally:
        spark.conf.set(files._OPEN_COST, before)


def test_a_folder_is_listed_by_a_task_as_spark_lists_it(spark, tmp_path):
    for name in ("a.pdf", "b c.pdf", "d%20.pdf", "ü.pdf", "e.f.pdf", "_x.pdf", "_y=1.pdf", "_metadata.pdf", ".z.pdf", "g.PDF", "h.txt"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "nothing.pdf").touch()
    os.symlink(tmp_path / "a.pdf", tmp_path / "link.pdf")
    os.symlink(tmp_path / "none.pdf", tmp_path / "lost.pdf")
    (tmp_path / "below.pdf").mkdir()
    (tmp_path / "below.pdf" / "inner.pdf").write_bytes(b"x")
    columns = ["path", "modificationTime", "length"]
    expected = sorted(files._listed(spark, str(tmp_path)).select(*columns).collect())
    for path in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        listed = files.list_files(spark, path)
        assert sorted(listed.select(*columns).collect()) == expected and len(expected) == 7
        assert listed.inputFiles() and not any(f.endswith(".pdf") for f in listed.inputFiles())  # the driver has no list of them
    assert {r.doc_stem for r in listed.collect()} >= {"b c", "d%20", "ü", "e.f", "link"}
    one = files.list_files(spark, f"{tmp_path}/a.pdf")
    assert [r.length for r in one.collect()] == [5]
    assert files.list_files(spark, f"{tmp_path}/[a]*.pdf").count() == 1


def test_a_folder_of_partitions_is_listed_as_before(spark, tmp_path):
    (tmp_path / "year=1").mkdir()
    (tmp_path / "year=1" / "a.pdf").write_bytes(b"x")
    (tmp_path / "empty").mkdir()
    assert [r.doc_stem for r in files.list_files(spark, str(tmp_path)).collect()] == ["a"]
    assert files.list_files(spark, f"{tmp_path}/empty").count() == 0


def test_large_files_take_a_task_each_and_small_ones_share(spark, tmp_path):
    for n in range(6):
        with open(tmp_path / f"large{n}.pdf", "wb") as f:
            f.truncate(1 << 30)  # sparse
    for n in range(50):
        (tmp_path / f"small{n}.pdf").write_bytes(b"x")
    listed = files.list_files(spark, str(tmp_path))
    dealt = [part for part in listed.rdd.glom().collect() if part]
    assert listed.rdd.getNumPartitions() <= 8 and sum(map(len, dealt)) == 56
    assert max(sum(r.length == 1 << 30 for r in part) for part in dealt) <= 2


def test_pages_of_short_files_share_batches_and_bytes_of_long_ones_do_not():
    short = [("s", 0, "text", None, None, None)] * 300
    assert [len(part) for part in extract._batched(short)] == [256, 44]
    long = [("l", None, None, None, 9, b"x" * (2 << 20))] * 3
    assert [len(part) for part in extract._batched([*short[:5], *long])] == [6, 1, 1]
    batch = extract._survey([short[0], long[0]], "binary")
    assert batch.column("page_num").to_pylist() == [0, None] and batch.column("stop").to_pylist() == [None, 9]
