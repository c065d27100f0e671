"""Whole runs: lazy plans composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import boilerplate, detect, documents, enrich, images, keys, markdown, pages as pg
from quire.schemas import BLOCK_PAGES, CATALOG
from quire.session import materialize, materialize_counted


def readable(pages: DataFrame) -> DataFrame:
    """Pages that were read. A failed page has no text, which says nothing about the page."""
    return pages.where(F.col("error").isNull()) if "error" in pages.columns else pages


@dataclass(frozen=True)
class Outputs:
    """Tables a run produces, and counts taken while it ran.

    ``described`` has a row an image that the model was asked about; None in a run without a model. ``written`` are the
    tables in the shared folder that documents and detections of a text-only run read (``session.discard``).
    """

    documents: DataFrame
    catalog: DataFrame
    detections: DataFrame
    counts: dict[str, int] = field(default_factory=dict)
    described: DataFrame | None = None
    written: tuple[DataFrame, ...] = ()


def cleaned_by_block(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Cleaned pages with ``block_no``, spread by page block.

    Header search, stripping and assembly all start from this one exchange, so the
    texts are cleaned once and shuffled once. For that, all of them have to need the
    same columns and filters below it: the key filter that a join would add to some of
    them is given here, and the edge count counts ``page_num``.
    """
    return keys.with_block(_cleaned(pages), block_pages).repartition("doc_stem", "block_no")


def _cleaned(pages: DataFrame) -> DataFrame:
    keyed = pages.where(F.col("doc_stem").isNotNull())
    source = [c for c in ("doc_stem", "page_num", "text", "error") if c in pages.columns]
    return pg.cleanup_text(keyed.select(*source))


def text_only_pipeline(
    pages: DataFrame,
    language: str = "th",
    block_pages: int = BLOCK_PAGES,
    keep_pages: bool = False,
    detect_trash: bool = True,
    title: Column | None = None,
) -> Outputs:
    """Clean, find and strip headers and footers, detect, assemble; no model.

    Documents and detections are separate lazy plans that start from the same pages.
    Where both are wanted, ``keep_pages`` writes the stripped pages to the shared
    folder first, so that they are cleaned once for both; ``counts`` then has the pages and those
    that could not be read. ``title`` is the name of a document where ``doc_stem`` is not.
    """
    cleaned = cleaned_by_block(pages, block_pages)
    # Where headers are written first, short lines leave the pages where they are read, and no text is moved for them.
    hf = boilerplate.headers_footers(_cleaned(pages) if keep_pages else cleaned, pages)
    if keep_pages:
        hf = materialize(hf, "headers")
    stripped = boilerplate.strip_headers_footers(cleaned, hf, block_pages, pages)
    counts: dict[str, int] = {}
    if keep_pages:
        failed = F.count("error") if "error" in pages.columns else F.lit(0).cast("long")
        stripped, counts = materialize_counted(stripped, "stripped", pages=F.count(F.lit(1)), page_errors=failed)
    docs = documents.assemble_documents(
        pg.assemble_pages(stripped), documents.text_only_head(language, title), pages, block_pages
    )
    empty = pages.sparkSession.createDataFrame([], CATALOG)
    found = detect.all_detections(readable(stripped), hf)
    written = (hf, stripped) if keep_pages else ()
    return Outputs(docs, empty, found if detect_trash else found.where(F.lit(False)), counts, written=written)


def vision_pipeline(
    pages: DataFrame,
    objects: DataFrame,
    describer: enrich.Describer,
    config: pg.Config = pg.Config(),
    base_delay: float = 1.0,
    prompts: dict[str, str] | None = None,
    block_pages: int = BLOCK_PAGES,
    block_width: int = 1024,
) -> Outputs:
    """Route, describe, assemble, catalogue and detect; headers are only reported.

    Texts are spread by page block once. Coverage and answers come to them as one map a block. Cleaned and routed
    pages are written to the shared folder, in buckets by block, because requests,
    bodies and detections all read them, each with columns of its own; page pictures are not among these. Answers of the
    model are written before anything uses them, so that the documents and the
    catalogue agree and a lost executor does not cause the calls to be made again.
    """
    source = [c for c in ("doc_stem", "page_num", "text", "error") if c in pages.columns]
    spread = keys.with_block(pg.cleanup_text(pages.select(*source)), block_pages).repartition("doc_stem", "block_no")
    routed, page_counts = materialize_counted(
        pg.route_pages(spread, images.image_coverage(objects), config, block_pages),
        "routed",
        by=["doc_stem", "block_no"],
        pages=F.count(F.lit(1)),
        page_errors=F.count("error") if "error" in source else F.lit(0).cast("long"),
    )
    read = readable(routed)
    pictures = pages.select("doc_stem", "page_num", "page_image") if "page_image" in pages.columns else None
    requests = enrich.description_requests(read, objects, config, block_width, pictures)
    answers = enrich.describe_images(requests, describer, config.max_retries, base_delay, prompts)
    described, image_counts = materialize_counted(
        enrich.settle_descriptions(answers),
        "descriptions",
        images=F.count(F.lit(1)),
        image_errors=F.count("error"),
    )
    docs = documents.assemble_documents(
        pg.assemble_pages(routed, described, block_pages),
        documents.vision_head(config.provider, config.model, config.quality),
        pages,
        block_pages,
    )
    catalog = images.catalog_rows(described, config.provider, config.model)
    if not config.detect_trash:
        found = detect.detect_trash(read).where(F.lit(False))
    else:
        found = detect.all_detections(read, boilerplate.headers_footers(read, routed))
    return Outputs(docs, catalog, found, {**page_counts, **image_counts}, described)


def strip_trash(docs: DataFrame, det: DataFrame, aliases=None) -> DataFrame:
    """Remove the pages that have a removable detection of the given types.

    Documents without one are passed on as they are.
    """
    removable = detect.filter_detections(det, aliases).select("doc_stem", "page")
    return markdown.remove_pages(docs, removable, only_listed=True, own_pages=True)


@dataclass(frozen=True)
class Deletion:
    """What an image deletion leaves behind."""

    documents: DataFrame
    catalog: DataFrame
    counts: DataFrame


def delete_images(docs: DataFrame, catalog: DataFrame, requests: DataFrame) -> Deletion:
    """Delete requested images from the catalogue and the Markdown.

    Names with ``..`` or a backslash are rejected. Documents without a request are passed
    on as they are. ``counts`` has, per requesting
    document, the accepted and rejected requests and the new image count, which is
    the old one less every accepted request, also repeated ones.
    """
    name = F.col("image_file")
    unsafe = F.contains(name, F.lit("..")) | F.contains(name, F.lit("\\"))
    # A rejected request still lists its document, but names no image.
    listed = requests.withColumn("image_file", F.when(~unsafe, name))
    accepted = requests.where(~unsafe).select("doc_stem", "image_file").distinct()
    asked = requests.groupBy("doc_stem").agg(
        F.count_if(~unsafe).alias("deleted"), F.count_if(unsafe).alias("failed")
    )
    had = catalog.groupBy("doc_stem").agg(F.count(F.lit(1)).alias("_had"))
    counts = asked.join(had, "doc_stem", "left").select(
        "doc_stem",
        "deleted",
        "failed",
        F.greatest(F.coalesce("_had", F.lit(0)) - F.col("deleted"), F.lit(0)).alias("image_count"),
    )
    return Deletion(
        images.remove_image_blocks(docs, listed, only_listed=True),
        catalog.join(accepted, ["doc_stem", "image_file"], "left_anti").select(*catalog.columns),
        counts,
    )
