"""A sink of one file per document that shows all of a write or nothing.

Tasks write their files into a folder of their own below ``_staging``, each with a list of what it wrote. When all are
done, the commit writes a mark and moves the files to their places; if a task fails for good, the folder is removed
and what was there before stays as it was. From the mark on the write holds: should the driver be lost while files
are moved, the next write to the place, or ``finish``, moves the rest. It also removes what tasks of a failed write
still left behind.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "quire_files"
SCHEMA = "folder string, doc_stem string, value string, replacing boolean"
_STAGING, _MARK, _GIVEN_UP = "_staging", "_COMMITTED", "_ABORTED"
# What Spark escapes in the names of partition folders, and the plus sign, which decoding takes for a blank.
_SPECIAL = re.compile(r"[\x00-\x1f\"#%'*+/:=?\\\x7f{\[\]^]")
_MOVES = 16  # at the same time


def open_target(uri: str):
    """pyarrow file system and base path of a Hadoop-style URI or local path."""
    from pyarrow import fs

    if uri.startswith(("s3a:", "s3n:")):
        uri = f"s3{uri[3:]}"
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].strip("/")
    store, base = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
    return store, base.rstrip("/")


def document_folder(folder: str, doc_stem: str) -> str:
    """Place of a document's file, named as Spark names partition folders."""
    return f"{folder}/doc_stem=" + _SPECIAL.sub(lambda m: f"%{ord(m[0]):02X}", doc_stem)


@dataclass
class _Written(WriterCommitMessage):
    listing: str
    files: int


class StagedFiles(DataSource):
    """``folder, doc_stem, value, replacing`` rows as files ``folder/doc_stem=…/part-0.txt``.

    A row that is ``replacing`` is written only where the document has that folder already.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri, self.run = uri, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, base = open_target(self.uri)
        own = f"{_STAGING}/{self.run}/{uuid.uuid4().hex}"  # of this attempt
        store.create_dir(f"{base}/{own}", recursive=True)
        lines, number = [], 0
        for batch in iterator:
            for row in batch.to_pylist():
                place = document_folder(row["folder"], row["doc_stem"])
                if row["replacing"] and not _exists(store, f"{base}/{place}"):
                    continue
                with store.open_output_stream(f"{base}/{own}/{number}") as out:
                    out.write((row["value"] + "\n").encode())
                lines.append(f"{own}/{number}\t{place}/part-0.txt\n")
                number += 1
        with store.open_output_stream(f"{base}/{own}/list") as out:
            out.write("".join(lines).encode())
        return _Written(f"{own}/list", number)

    def commit(self, messages: list[_Written | None]) -> None:
        store, base = open_target(self.uri)
        done = [m for m in messages if m is not None]
        store.create_dir(f"{base}/{_STAGING}/{self.run}", recursive=True)
        with store.open_output_stream(f"{base}/{_STAGING}/{self.run}/{_MARK}") as out:
            out.write("\n".join(m.listing for m in done).encode())
        _publish(store, base, self.run)

    def abort(self, messages: list[_Written | None]) -> None:
        store, base = open_target(self.uri)
        own = f"{base}/{_STAGING}/{self.run}"
        if _exists(store, own):
            store.delete_dir_contents(own)
        # Other tasks may not have stopped yet.
        store.create_dir(own, recursive=True)
        with store.open_output_stream(f"{own}/{_GIVEN_UP}"):
            pass


def _exists(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def _read(store, path: str) -> str:
    with store.open_input_file(path) as file:
        return file.read().decode()


def _publish(store, base: str, run: str) -> None:
    """Move the files of a marked write to their places, list by list; those already there are passed over."""

    def move(line: str) -> None:
        staged, place = line.split("\t")
        if _exists(store, f"{base}/{staged}"):
            store.create_dir(f"{base}/{place.rsplit('/', 1)[0]}", recursive=True)
            store.move(f"{base}/{staged}", f"{base}/{place}")

    with ThreadPoolExecutor(_MOVES) as pool:
        for listing in filter(None, _read(store, f"{base}/{_STAGING}/{run}/{_MARK}").split("\n")):
            list(pool.map(move, filter(None, _read(store, f"{base}/{listing}").split("\n"))))
    store.delete_dir(f"{base}/{_STAGING}/{run}")


def finish(uri: str) -> int:
    """Finish writes that were marked but not moved to the end; returns how many. Those under way are left alone."""
    from pyarrow import fs

    store, base = open_target(uri)
    if not _exists(store, f"{base}/{_STAGING}"):
        return 0
    runs = [i.base_name for i in store.get_file_info(fs.FileSelector(f"{base}/{_STAGING}"))]
    marked = [r for r in runs if _exists(store, f"{base}/{_STAGING}/{r}/{_MARK}")]
    for run in marked:
        _publish(store, base, run)
    for run in set(runs) - set(marked):
        if _exists(store, f"{base}/{_STAGING}/{run}/{_GIVEN_UP}"):
            store.delete_dir(f"{base}/{_STAGING}/{run}")
    return len(marked)


def write_files(spark: SparkSession, rows: DataFrame, uri: str, folders: tuple[str, ...] = ()) -> None:
    """Write ``folder, doc_stem, value, replacing`` rows below ``uri``, all of them or none.

    ``folders`` are there afterwards even if no row is for them.
    """
    finish(uri)
    store, base = open_target(uri)
    for folder in folders:
        store.create_dir(f"{base}/{folder}", recursive=True)
    spark.dataSource.register(StagedFiles)
    columns = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    rows.select(*columns).write.format(FORMAT).option("path", uri).mode("append").save()


def _delete(rows: DataFrame, uri: str, path_of: Callable[..., str]) -> int:
    """Remove in tasks what the paths made from rows name; returns how many there were."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = open_target(uri)
        for batch in batches:
            removed = 0
            for row in batch.to_pylist():
                path = path_of(**row)
                if not path or ".." in path.split("/") or "\\" in path or path.startswith("/"):
                    continue
                kind = store.get_file_info(f"{base}/{path}").type
                if kind == fs.FileType.Directory:
                    store.delete_dir(f"{base}/{path}")
                elif kind == fs.FileType.File:
                    store.delete_file(f"{base}/{path}")
                removed += kind in (fs.FileType.Directory, fs.FileType.File)
            yield pa.RecordBatch.from_arrays([pa.array([removed], pa.int64())], ["removed"])

    done = rows.mapInArrow(remove, "removed bigint")
    return done.agg(F.coalesce(F.sum("removed"), F.lit(0))).first()[0]


def delete_paths(paths: DataFrame, uri: str) -> int:
    """Remove files and folders by their ``path`` below ``uri``; returns how many there were.

    A path with ``..`` or a backslash, or one that begins at the root, is passed over.
    """
    return _delete(paths.select("path").distinct(), uri, lambda path: path)


def delete_files(documents: DataFrame, uri: str, folders: list[str]) -> int:
    """Remove the files of documents (``doc_stem``) below the folders; returns how many there were."""
    each = F.explode(F.array(*map(F.lit, folders))).alias("folder")
    return _delete(documents.select("doc_stem").distinct().select("doc_stem", each), uri, document_folder)
