"""Extraction of one file's pages by many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

RANGE_PAGES = 256
PAGES = "doc_stem string, page_num int, text string, error string"
_BATCH_ROWS, _BATCH_CHARS = 256, 1 << 20
_NAMES = ["doc_stem", "page_num", "text", "error"]


class PageReader(Protocol):
    """Reads the pages of a file by number."""

    def count(self, content: bytes) -> int:
        """How many pages the file has; raises if it cannot be read at all."""

    def read(self, content: bytes, first: int, stop: int) -> Iterable[Any]:
        """The pages from ``first`` up to ``stop``, each a text or an exception."""


def pages_in_ranges(
    files: DataFrame,
    reader: PageReader,
    start: int = 0,
    end: int | None = None,
    range_pages: int = RANGE_PAGES,
    opener: Callable[[str], bytes] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Pages of files, ranges of a long file read by different tasks: ``doc_stem, page_num, text, error``.

    In the first of two steps each file's pages are counted. A file of at most ``range_pages`` pages is read
    there and then; a longer one gives only its page count. In the second step the ranges of the longer ones are
    dealt over ``tasks`` (as many as shuffle partitions), and each task opens the files of its ranges. What the
    first step gives is a table in the shared folder, so the reader is not called again for it.

    ``files`` has ``doc_stem`` and ``content``, and ``error`` for files that were refused. With an ``opener``, which takes
    a path and returns the bytes, ``path`` stands for ``content``: a file's bytes are then never in a row, so they
    may be of any size, and do not travel. Without one, the bytes go with each of the file's ranges.

    A page that cannot be read is an error row and the next one is tried, so the rows do not depend on
    ``range_pages``. A file that cannot be opened or counted is one error row at ``start``. With ``start`` and ``end``, only
    those pages are read.
    """
    source = "path" if opener else "content"
    kept = "string" if opener else "binary"

    def load(value: Any) -> bytes:
        return opener(value) if opener else bytes(value)

    def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            refused = batch.column("error") if "error" in batch.schema.names else None
            for i in range(batch.num_rows):
                stem, value = batch.column("doc_stem")[i].as_py(), batch.column(source)[i].as_py()
                problem = refused[i].as_py() if refused is not None else None
                if problem is None and value is None:
                    problem = "no content"
                if problem is None:
                    try:
                        content = load(value)
                        stop = reader.count(content)
                        stop = stop if end is None else min(stop, end)
                    except Exception as err:
                        problem = str(err)
                if problem is not None:
                    yield stem, start, "", problem, None, None
                elif stop - start > range_pages:
                    yield stem, None, None, None, stop, value
                else:
                    for row in _read(reader, content, stem, start, stop):
                        yield *row, None, None

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pages of many short files go back together.
        for rows in _batched(surveyed(batches)):
            yield _survey(rows, kept)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, content = None, b""
        for batch in batches:
            for row in batch.to_pylist():
                first, stop = row["first"], min(row["first"] + range_pages, row["stop"])
                try:
                    if opener is None or opened != row["source"]:
                        content, opened = load(row["source"]), row["source"] if opener else None
                    rows = _read(reader, content, row["doc_stem"], first, stop)
                except Exception as err:
                    opened, problem = None, str(err)
                    rows = ((row["doc_stem"], page, "", problem) for page in range(first, stop))
                for part in _batched(rows):
                    yield _pages(part)

    columns = [c for c in ("doc_stem", source, "error") if c in files.columns]
    seen = files.select(*columns).mapInArrow(survey, f"{PAGES}, stop int, source {kept}")
    seen = materialize(seen, "pages-surveyed")
    short = seen.where(F.col("page_num").isNotNull()).select(*_NAMES)
    long = seen.where(F.col("page_num").isNull())
    ranges = long.select(
        "doc_stem", "stop", "source", F.explode(F.sequence(F.lit(start), F.col("stop") - 1, F.lit(range_pages))).alias("first")
    )
    tasks = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return short.unionByName(ranges.repartition(tasks).mapInArrow(extract, PAGES))


def _read(reader: PageReader, content: bytes, stem: str, first: int, stop: int) -> Iterator[tuple]:
    """Rows of the pages; each page that fails is one, and reading goes on behind it."""
    page = first
    while page < stop:
        try:
            for item in reader.read(content, page, stop):
                if page == stop:
                    break
                failed = isinstance(item, Exception)
                yield stem, page, "" if failed else item, str(item) if failed else None
                page += 1
            problem = "the reader gave no such page"
        except Exception as err:
            problem = str(err)
        if page < stop:
            yield stem, page, "", problem
            page += 1


def _batched(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    part: list[tuple] = []
    size = 0
    for row in rows:
        part.append(row)
        size += sum(len(value) for value in row[2::3] if value is not None)  # text, and the source of a long file
        if len(part) == _BATCH_ROWS or size > _BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def _survey(rows: list[tuple], kept: str) -> pa.RecordBatch:
    pages = _pages([row[:4] for row in rows])
    stops, sources = zip(*[row[4:] for row in rows])
    kind = pa.string() if kept == "string" else pa.binary()
    more = [pa.array(stops, pa.int32()), pa.array(sources, kind)]
    return pa.RecordBatch.from_arrays([*pages.columns, *more], [*_NAMES, "stop", "source"])


def open_file(path: str) -> bytes:
    """Bytes of a file by its URI, as an opener for ``pages_in_ranges``."""
    from pyarrow import fs

    address = f"s3{path[3:]}" if path.startswith(("s3a:", "s3n:")) else path
    if path.startswith("file:"):
        store, address = fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    else:
        store, address = fs.FileSystem.from_uri(address)
    with store.open_input_file(address) as file:
        return file.read()
