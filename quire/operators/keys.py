"""Helpers that keep work on a document evenly spread.

A document may hold any share of the corpus, so nothing is gathered per document.
Rows are gathered per *page block*, a fixed number of consecutive pages of one
document, and facts about a document are joined to its pages by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.schemas import BLOCK_PAGES


def page_block(page_num: str | Column = "page_num", block_pages: int = BLOCK_PAGES) -> Column:
    """Number of the block that a 0-based page belongs to."""
    page = F.col(page_num) if isinstance(page_num, str) else page_num
    return F.floor(page / F.lit(block_pages)).cast("int")


def with_block(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Pages with their ``block_no``; a block number already there is kept.

    Keeping the column keeps a partitioning on it, so later steps need no shuffle.
    """
    if "block_no" in pages.columns:
        return pages
    return pages.withColumn("block_no", page_block("page_num", block_pages))


def document_pages(pages: DataFrame) -> DataFrame:
    """``doc_stem, pages``; reads no text."""
    return pages.groupBy("doc_stem").agg(F.count(F.lit(1)).alias("pages"))


def document_blocks(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """One row per page block: ``doc_stem, block_no, pages, last_block``.

    ``pages`` counts the whole document. Only block rows, one per ``block_pages``
    pages, meet in the join, so a long document stays a short list.
    """
    blocks = (
        with_block(pages, block_pages)
        .groupBy("doc_stem", "block_no")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = blocks.groupBy("doc_stem").agg(
        F.sum("n").alias("pages"), F.max("block_no").alias("last_block")
    )
    return blocks.drop("n").join(totals, "doc_stem")


def facts_by_block(facts: DataFrame, out: str, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Rows of pages (one a page) as a map by page number: ``doc_stem, block_no`` and the map ``out``.

    Joined to pages that are spread by block, it moves none of their texts. A map has at most a block's pages.
    """
    fields = [c for c in facts.columns if c not in ("doc_stem", "page_num", "block_no")]
    entry = F.struct("page_num", F.struct(*fields))
    numbered = with_block(facts.where(F.col("page_num").isNotNull()), block_pages)
    grouped = numbered.groupBy("doc_stem", "block_no")
    return grouped.agg(F.map_from_entries(F.collect_list(entry)).alias(out))


def joined_facts(pages: DataFrame, facts: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """``pages`` with the columns of ``facts`` (one row a page, or none: then null)."""
    fields = [c for c in facts.columns if c not in ("doc_stem", "page_num", "block_no")]
    if "block_no" not in pages.columns:
        return pages.join(facts.drop("block_no"), ["doc_stem", "page_num"], "left")
    met = pages.join(facts_by_block(facts, "_facts", block_pages), ["doc_stem", "block_no"], "left")
    own = F.try_element_at("_facts", F.col("page_num"))
    return met.withColumn("_own", own).select(*pages.columns, *[F.col(f"_own.{f}").alias(f) for f in fields])


def whole_documents(docs: DataFrame) -> DataFrame:
    """``doc_stem, markdown``: the rows of each document joined by a newline.

    What counts or searches across a document starts from this, so that no result
    depends on the size of the blocks in which the document was assembled.
    """
    if "block_no" not in docs.columns:
        return docs
    rows = F.sort_array(F.collect_list(F.struct("block_no", "markdown")))
    return docs.groupBy("doc_stem").agg(F.array_join(rows["markdown"], "\n").alias("markdown"))


def doc_keys(docs: DataFrame) -> list[str]:
    """Key columns of a Markdown table: with or without block numbers."""
    return [c for c in ("doc_stem", "block_no") if c in docs.columns]


def matched_per_document(
    docs: DataFrame, items: Column, facts: DataFrame, item: str, out: str, *extra: str
) -> DataFrame:
    """Facts whose ``item`` occurs in a document row, gathered into one set per row.

    ``items`` is the array of values that occur in the row itself. Only those values
    and the facts are shuffled, never the text, and a set can hold no more distinct
    values than its own row does. ``facts`` is keyed by ``doc_stem, item``
    and must be unique on them when ``extra`` columns are gathered along.
    """
    keys = doc_keys(docs)
    occurring = docs.select(*keys, F.explode(F.array_distinct(items)).alias(item))
    if extra:
        hits = occurring.join(facts.select("doc_stem", item, *extra), ["doc_stem", item])
        value = F.struct(item, *extra)
    else:
        hits = occurring.join(facts.select("doc_stem", item), ["doc_stem", item], "left_semi")
        value = F.col(item)
    return hits.groupBy(*keys).agg(F.collect_set(value).alias(out))


def rank_in_blocks(
    rows: DataFrame, keys: list[str], order: str, out: str, block_width: int
) -> DataFrame:
    """Position of a row within its group by an integer order column, from 1.

    The group is numbered in ranges of ``block_width`` order values: each range is
    numbered on its own and shifted by the size of the ranges before it. A group that
    fits one range meets an empty shift table, which adaptive execution drops.
    """
    blocked = rows.withColumn("_blk", F.floor(F.col(order) / F.lit(block_width)))
    in_block = blocked.withColumn(
        "_pos", F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy(order))
    )
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        blocked.groupBy(*keys, "_blk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.sum("_n").over(before))
        .where(F.col("_shift").isNotNull())
        .drop("_n")
    )
    return (
        in_block.join(shifts, [*keys, "_blk"], "left")
        .withColumn(out, (F.col("_pos") + F.coalesce("_shift", F.lit(0))).cast("int"))
        .drop("_blk", "_pos", "_shift")
    )
