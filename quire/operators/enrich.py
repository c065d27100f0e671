"""Stages that call caller-supplied Python: page extraction and image description."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.images import image_file, keep_large_images
from quire.operators.pages import Config, failed_text

Describer = Callable[[dict[str, Any]], str]

HINT_BYTES = 4000
PAGES = "doc_stem string, page_num int, text string, error string"


def pages_from_documents(
    files: DataFrame,
    extractor: Callable[[bytes], Iterable[Any]],
    start: int = 0,
    end: int | None = None,
) -> DataFrame:
    """Run a page extractor over file bytes: ``doc_stem, page_num, text, error``.

    The extractor takes the bytes of one file and yields one item per page: the text,
    or an exception for a page that cannot be read. A failing page or file, and one
    refused with an ``error`` and no content, gives an error row and the run goes on. Pages are yielded in batches while a file is read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            refused = batch["error"] if "error" in batch else [None] * len(batch)
            rows: list[tuple] = []  # pages of many short files go back together
            for stem, content, problem in zip(batch["doc_stem"], batch["content"], refused):
                found = _read_pages(extractor, bytes(content)) if content is not None else [(0, "", problem)]
                for page_num, text, error in found:
                    if end is not None and page_num >= end:
                        break  # the extractor need not go on
                    if page_num < start:
                        continue
                    rows.append((stem, page_num, text, error))
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=["doc_stem", "page_num", "text", "error"])
                        rows = []
            yield pd.DataFrame(rows, columns=["doc_stem", "page_num", "text", "error"])

    columns = [c for c in ("doc_stem", "content", "error") if c in files.columns]
    return files.select(*columns).mapInPandas(run, PAGES)


def _read_pages(extractor, content: bytes) -> Iterator[tuple[int, str, str | None]]:
    page_num = -1
    try:
        for page_num, item in enumerate(extractor(content)):
            if isinstance(item, Exception):
                yield page_num, "", str(item)
            else:
                yield page_num, item, None
    except Exception as err:
        # The extractor stopped: the page after the last good one is the failed one.
        yield page_num + 1, "", str(err)


def description_requests(
    routed: DataFrame,
    objects: DataFrame,
    config: Config = Config(),
    block_width: int = 1024,
    page_images: DataFrame | None = None,
) -> DataFrame:
    """Images to describe: one per rendered page or table, one per large image.

    Columns: ``doc_stem, page_num, kind, index, width, height, image_ref, hint``,
    ``fallback`` (the page text that replaces a failed high-quality answer) and
    ``content`` (bytes from ``page_image`` of ``page_images``, or else of the pages, and ``content`` of the
    objects, where given). Images of a page are only asked about when it is routed as mixed.
    """
    strategy = F.col("strategy")
    kind = (
        F.when(strategy == "high_quality", "hq")
        .when(strategy == "full_page", "full")
        .when(F.col("table_candidate"), "table")
    )
    none = F.lit(None)
    has_text = (strategy == "high_quality") & (F.col("text") != "")
    page_level = (
        routed.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "doc_stem",
            "page_num",
            "kind",
            none.cast("int").alias("index"),
            none.cast("int").alias("width"),
            none.cast("int").alias("height"),
            F.when(has_text, tx.cut_bytes(F.col("text"), HINT_BYTES)).alias("hint"),
            F.when(has_text, F.col("text")).alias("fallback"),
            (F.col("page_image") if "page_image" in routed.columns else none.cast("binary")).alias("content"),
        )
    )
    if page_images is not None:
        # Pictures meet the pages that are asked about, and take no part in what is done with texts.
        pictures = page_images.select("doc_stem", "page_num", F.col("page_image").alias("content"))
        wide = page_level.drop("content").join(pictures, ["doc_stem", "page_num"], "left")
        page_level = wide.select(*page_level.columns)
    requests = page_level
    if config.quality.lower() != "high":
        mixed = routed.where(strategy == "mixed").select("doc_stem", "page_num")
        images = keep_large_images(objects, config.min_image_size, block_width)
        requests = page_level.unionByName(
            images.join(mixed, ["doc_stem", "page_num"], "left_semi").select(
                "doc_stem",
                "page_num",
                F.lit("img").alias("kind"),
                "index",
                F.col("px_w").alias("width"),
                F.col("px_h").alias("height"),
                none.cast("string").alias("hint"),
                none.cast("string").alias("fallback"),
                (F.col("content") if "content" in objects.columns else none.cast("binary")).alias("content"),
            )
        )
    return requests.withColumn("image_ref", image_file(F.col("kind"), F.col("index")))


def describe_images(
    requests: DataFrame,
    describer: Describer,
    retries: int = 3,
    base_delay: float = 1.0,
    prompts: dict[str, str] | None = None,
    partitions: int | None = None,
    concurrency: int = 5,
) -> DataFrame:
    """Ask the model about every request row; adds ``description, error, attempts``.

    Image bytes and hints stay behind: they go to Python with a request, not back.

    ``describer`` gets the row as a dict, with ``prompt`` chosen from ``prompts`` by
    kind (``hq_hint`` with ``{hint_text}`` when a hint is there), and returns text or
    raises. A failing call is tried ``retries`` times, waiting ``base_delay * 2**n``
    seconds in between; after that the error is kept and the run goes on.
    Each of ``partitions`` tasks makes ``concurrency`` calls at the same time, and holds
    the images of a few rounds of calls.
    """
    prompts = prompts or {}
    kept = [f for f in requests.schema if f.name not in ("content", "hint")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ask(row: dict[str, Any]) -> tuple:
            return _ask(describer, {**row, "prompt": _prompt(prompts, row)}, retries, base_delay)

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 4 * concurrency):
                    part = batch.slice(at, 4 * concurrency)
                    answers = list(pool.map(ask, part.to_pylist()))
                    columns = [
                        pa.array([a[0] for a in answers], pa.string()),
                        pa.array([a[1] for a in answers], pa.string()),
                        pa.array([a[2] for a in answers], pa.int32()),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(f.name) for f in kept), *columns],
                        names=[*(f.name for f in kept), "description", "error", "attempts"],
                    )

    spread = requests.repartition(partitions) if partitions else requests
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return spread.mapInArrow(run, f"{schema}, description string, error string, attempts int")


def _prompt(prompts: dict[str, str], row: dict[str, Any]) -> str:
    kind = row["kind"]
    if kind == "hq" and row.get("hint") and "hq_hint" in prompts:
        return prompts["hq_hint"].replace("{hint_text}", row["hint"])
    return prompts.get(kind, "")


def _ask(describer, row: dict[str, Any], retries: int, base_delay: float):
    last = ""
    for attempt in range(retries):
        try:
            return str(describer(row)).strip(), None, attempt + 1
        except Exception as err:
            last = str(err)
            if attempt < retries - 1:
                time.sleep(base_delay * 2**attempt)
    return None, f"failed after {retries} attempts: {last}", retries


def settle_descriptions(described: DataFrame) -> DataFrame:
    """Fill failed descriptions with the page text or a placeholder, by kind."""
    kind, error = F.col("kind"), F.col("error")
    filled = (
        F.when(kind == "hq", F.coalesce("description", "fallback", failed_text("hq", error)))
        .when(kind == "table", F.coalesce("description", failed_text("table", error)))
        .otherwise(F.coalesce("description", failed_text("img", error)))
    )
    return described.withColumn("description", filled).drop("fallback", "hint", "content")
