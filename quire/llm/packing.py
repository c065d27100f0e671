"""Token ids in files of fixed-width packed bits.

Method. Every id takes as many bits as the largest id of the vocabulary needs. A file
holds blocks of ``BLOCK_IDS`` ids, each starting at a byte; eight ids fill ``width``
bytes, so packing and unpacking are shifts of whole columns in numpy. A footer has the
offset of each block and the first id of each document, so that any range is read
by fetching its blocks alone.

File: the magic word, the blocks, then the footer: block offsets (int64), document ids
(int64), a byte each telling null ids, document starts (int64, one more than
documents); last four int64: number of ids, of documents, of blocks, and the width.

Texts are encoded by the tokenizers library. Its pre-tokens are found by array operations
(``bpe``, with the character classes of that library); each distinct one is encoded
by the library once while it stays in the cache. A text that holds an added token of the
file, which the library matches before it cuts pre-tokens, goes through the library whole.

Files are written under names of their own by each attempt; the table of files lists
those of finished tasks alone, so a repeated task leaves nothing wrong behind.

Edge cases. Null and empty texts give the end id alone. Rows of equal id keep their place
by text; a null id comes first. An empty table gives no file. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe
from quire.llm.common import fresh, open_store, slices, texts_of, tidy
from quire.session import materialize, new_folder

MAGIC = b"QIDS0001"
BLOCK_IDS = 1 << 16
READ_IDS = 1 << 20


def width_of(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids side by side, lowest bits first; the last byte is filled with zeros."""
    groups = -(-len(ids) // 8)
    values = np.zeros((groups, 8), np.uint64)
    values.ravel()[: len(ids)] = ids
    out = np.zeros((groups, width + 8), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * width, 8)
        moved = values[:, lane] << np.uint64(shift)
        for k in range(-(-(width + shift) // 8)):
            out[:, byte + k] |= (moved >> np.uint64(8 * k)).astype(np.uint8)
    return out[:, :width].tobytes()[: -(-len(ids) * width // 8)]


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` ids of a block."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    groups = -(-count // 8)
    grid = np.zeros((groups, width), np.uint8)
    grid.ravel()[: len(data)] = np.frombuffer(data, np.uint8)[: groups * width]
    out = np.zeros((groups, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * width, 8)
        value = np.zeros(groups, np.uint64)
        for k in range(-(-(width + shift) // 8)):
            value |= grid[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & mask
    return out.ravel()[:count]


class Writer:
    """Writes one file, block by block; holds one block of ids and the document table."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.out.write(MAGIC)
        self.at, self.blocks, self.total = len(MAGIC), [], 0
        self.waiting: list[np.ndarray] = []
        self.waiting_ids = 0
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.starts = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.total += len(ids)
        self.starts.append(self.total)
        self.waiting.append(ids)
        self.waiting_ids += len(ids)
        if self.waiting_ids >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        at = 0
        while len(ids) - at >= BLOCK_IDS or last and at < len(ids):
            data = pack(ids[at : at + BLOCK_IDS], self.width)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
            at += BLOCK_IDS
        self.waiting = [ids[at:]]
        self.waiting_ids = max(0, len(ids) - at)

    def close(self) -> None:
        self._flush(True)
        self.blocks.append(self.at)
        counts = [self.total, len(self.docs), len(self.blocks), self.width]
        for values, kind in (
            (self.blocks, "<i8"),
            (self.docs, "<i8"),
            (self.nulls, "u1"),
            (self.starts, "<i8"),
            (counts, "<i8"),
        ):
            self.out.write(np.array(values, kind).tobytes())
        self.out.close()


class Reader:
    """Random access to one file: ``ids(start, stop)`` fetches only the blocks it needs."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 32)
        self.total, docs, blocks, self.width = np.frombuffer(file.read(32), "<i8").tolist()
        length = 8 * blocks + 8 * docs + docs + 8 * (docs + 1)
        file.seek(size - 32 - length)
        footer = file.read(length)
        self.blocks = np.frombuffer(footer, "<i8", blocks)
        at = 8 * blocks
        self.doc_ids = np.frombuffer(footer, "<i8", docs, at)
        self.nulls = np.frombuffer(footer, "u1", docs, at + 8 * docs).astype(bool)
        self.starts = np.frombuffer(footer, "<i8", docs + 1, at + 9 * docs)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK_IDS, -(-stop // BLOCK_IDS)
        self.file.seek(int(self.blocks[first]))
        data = self.file.read(int(self.blocks[last] - self.blocks[first]))
        base = int(self.blocks[first])
        out = []
        for b in range(first, last):
            count = min(BLOCK_IDS, self.total - b * BLOCK_IDS)
            part = data[int(self.blocks[b]) - base : int(self.blocks[b + 1]) - base]
            out.append(unpack(part, self.width, count))
        flat = np.concatenate(out)
        return flat[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]


@lru_cache(maxsize=1)
def library_classes() -> tuple[np.ndarray, np.ndarray]:
    """Character classes as the tokenizers library sees them."""
    from tokenizers import Regex, pre_tokenizers

    text = bpe.every_character()

    def members(other: str) -> set:
        split = pre_tokenizers.Split(Regex(other), "removed")
        return {ord(c) for piece, _ in split.pre_tokenize_str(text) for c in piece}

    return bpe.class_runs(members(r"[^\p{L}]+"), members(r"[^\p{N}]+"), members(r"\S+"))


def byte_letters() -> dict[int, str]:
    """The letter by which the library's byte-level vocabulary writes each byte.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for the
    characters from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def library_merger(tokenizer_file: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of pieces from the library's model, which takes a pre-token in its byte letters."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file).model
    letters = byte_letters()

    def merge(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letters))] for p in pieces]
        ids = np.fromiter((i for own in found for i in own), np.int32)
        return ids, np.fromiter(map(len, found), np.int64, len(found))

    return merge


class Encoder:
    """Ids of texts as the library gives them at its default setting, without special tokens around."""

    def __init__(self, tokenizer_file: str, runs: tuple[np.ndarray, np.ndarray]):
        from tokenizers import Tokenizer

        self.table = bpe.class_table(runs)
        self.cache = bpe.PieceCache(library_merger(tokenizer_file))
        self.library = Tokenizer.from_file(tokenizer_file)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        whole = {i for i, text in enumerate(texts) if any(content in text for content in self.added)}
        plain = ["" if i in whole else text for i, text in enumerate(texts)]
        ids, counts = bpe.encode_texts(plain, self.table, self.cache)
        out = np.split(ids, np.cumsum(counts)[:-1])
        for i in whole:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out


def write_tokens(
    docs: DataFrame, tokenizer_file: str, folder: str, vocabulary: int, end_id: int = 0
) -> DataFrame:
    """Encode texts into files in ascending ``doc_id`` order; returns the table of files.

    Columns: shard (its order), path, n_docs, n_ids. ``docs`` has doc_id and text.
    """
    runs = library_classes()
    width = width_of(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(tokenizer_file, runs)
        shard = TaskContext.get().partitionId()
        writer, end = None, np.array([end_id], np.int32)
        for batch in tidy(batches):
            for part in slices(batch, bpe.BATCH_BYTES):
                if writer is None:
                    store, base = open_store(folder)
                    store.create_dir(base, recursive=True)
                    name = fresh(f"{shard:06d}", "ids")
                    writer = Writer(store.open_output_stream(f"{base}/{name}"), width)
                keys = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                for key, own in zip(keys, encode(texts_of(part))):
                    writer.add(key, np.concatenate([own, end]))
        if writer is not None:
            writer.close()
            row = [[shard], [f"{folder}/{name}"], [len(writer.docs)], [writer.total]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in row], ["shard", "path", "n_docs", "n_ids"]
            )

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id")
    files = ordered.sortWithinPartitions("doc_id", "text").mapInArrow(
        run, "shard long, path string, n_docs long, n_ids long"
    )
    return materialize(files, "token-files")


def read_tokens(files: DataFrame, schema: str, of_document: Callable) -> DataFrame:
    """One row per document, in files of ``write_tokens``.

    ``of_document(start, ids)`` gives the values of ``schema`` after ``doc_id``; start
    counts the ids of all documents before. Only the table of files, a row for each
    writing task, passes through the driver, for the ids before each file.
    """
    spark, before, rows = files.sparkSession, 0, []
    for row in files.orderBy("shard").collect():  # a row a file, as many as the writing tasks
        rows.append((row["path"], before))
        before += row["n_ids"]
    based = spark.createDataFrame(rows, "path string, base long")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_file(path) as file:
                    yield from _documents(Reader(file), row["base"])

    def _documents(reader: Reader, base: int) -> Iterator[pa.RecordBatch]:
        first, docs = 0, len(reader.doc_ids)
        while first < docs:
            limit = reader.starts[first] + READ_IDS
            last = max(first + 1, int(np.searchsorted(reader.starts, limit, side="right")) - 1)
            start = int(reader.starts[first])
            ids = reader.ids(start, int(reader.starts[last]))
            rows = []
            for i in range(first, last):
                a, b = int(reader.starts[i]), int(reader.starts[i + 1])
                key = None if reader.nulls[i] else int(reader.doc_ids[i])
                rows.append((key, *of_document(base + a, ids[a - start : b - start])))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
            yield pa.RecordBatch.from_arrays(columns, arrow.names)
            first = last

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(f"doc_id long, {schema}")
    arrow = to_arrow_schema(kind)
    return based.select("path", "base").repartition(tasks, "path").mapInArrow(run, kind)


def digest(start: int, ids: np.ndarray) -> tuple[int, int, int]:
    """start, n_tokens, ids_crc32."""
    return start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


DIGEST = "start long, n_tokens long, ids_crc32 long"


def packed_digests(spark: SparkSession, docs: DataFrame, tokenizer_file: str, vocabulary: int) -> DataFrame:
    """Write the ids of all texts, read the files back, and digest each document's ids."""
    folder = new_folder(spark, "token-ids")
    files = write_tokens(docs, tokenizer_file, folder, vocabulary)
    return read_tokens(files, DIGEST, digest)
