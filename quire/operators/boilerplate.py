"""Repeated headers and footers: counting, finding, stripping, reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.keys import document_pages, with_block
from quire.schemas import BLOCK_PAGES

EDGE_LINES = 3
MAX_LINE_BYTES = 200
MIN_PAGES = 3
# A page adds at most EDGE_LINES to an edge and a repeated line needs 60 % of the
# pages, so no more than this many lines of one edge can qualify.
MAX_REPEATED = 5


def _edge(text: Column, edge: str) -> Column:
    body = tx.without_last_newline(text)
    count = EDGE_LINES if edge == "header" else -EDGE_LINES
    lines = F.split(F.substring_index(body, "\n", count), "\n", -1)
    return F.transform(
        lines, lambda line: F.struct(F.lit(edge).alias("edge"), tx.trim_ws(line).alias("line"))
    )


def edge_line_counts(pages: DataFrame) -> DataFrame:
    """``doc_stem, edge, line, n``: how often a line is among the first or last three.

    At most six short lines leave a page, and they are counted before the shuffle.
    """
    text = F.col("text")
    return (
        pages.select(
            "doc_stem",
            "page_num",
            F.explode(F.concat(_edge(text, "header"), _edge(text, "footer"))).alias("e"),
        )
        .select("doc_stem", "page_num", "e.edge", "e.line")
        .where((F.col("line") != "") & (F.octet_length("line") < MAX_LINE_BYTES))
        .groupBy("doc_stem", "edge", "line")
        .agg(F.count("page_num").alias("n"))
    )


def headers_footers(pages: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``doc_stem, edge, line, n, pages`` of lines repeated on 60 % of the pages.

    Documents of fewer than three pages have none. Only the five most frequent lines
    of an edge can reach 60 %, so the rank limit drops all others before they are
    shuffled, however many distinct lines a document has. ``keys`` is any table with
    the same page keys that is cheaper to count than ``pages``.
    """
    by_count = Window.partitionBy("doc_stem", "edge").orderBy(F.desc("n"))
    candidates = (
        edge_line_counts(pages)
        .withColumn("_rank", F.row_number().over(by_count))
        .where(F.col("_rank") <= MAX_REPEATED)
        .drop("_rank")
    )
    totals = document_pages(pages if keys is None else keys)
    return candidates.join(totals, "doc_stem").where(
        (F.col("pages") >= MIN_PAGES) & (F.col("n") * 10 >= F.col("pages") * 6)
    ).select("doc_stem", "edge", "line", "n", "pages")


def strip_headers_footers(
    pages: DataFrame,
    hf: DataFrame,
    block_pages: int = BLOCK_PAGES,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Remove header and footer lines wherever they stand on a page of their document.

    The at most ten lines of a document are copied to each of its page blocks and
    joined by block, so the pages of one long document spread over many tasks. ``keys``
    is any table with the same page keys that is cheaper to list than ``pages``.
    """
    lines = hf.groupBy("doc_stem").agg(F.collect_set("line").alias("_hf"))
    blocks = with_block(pages if keys is None else keys, block_pages)
    per_block = blocks.select("doc_stem", "block_no").distinct().join(lines, "doc_stem")
    kept = F.filter(
        tx.text_lines(F.col("text")),
        lambda line: ~F.array_contains(F.col("_hf"), tx.trim_ws(line)),
    )
    stripped = tx.trim_ws(F.array_join(kept, "\n"))
    text = F.when(F.col("_hf").isNull(), F.col("text")).otherwise(stripped)
    joined = with_block(pages, block_pages).join(per_block, ["doc_stem", "block_no"], "left")
    return joined.withColumn("text", text).select(*pages.columns)


def header_footer_detection(hf: DataFrame) -> DataFrame:
    """One detection per document that lists its headers, then its footers (sorted)."""
    entry = F.concat(
        F.when(F.col("edge") == "header", F.lit('Header: "')).otherwise(F.lit('Footer: "')),
        F.col("line"),
        F.lit('"'),
    )
    order = F.when(F.col("edge") == "header", 0).otherwise(1)
    parts = F.sort_array(F.collect_list(F.struct(order.alias("o"), "line", entry.alias("entry"))))
    listed = hf.groupBy("doc_stem").agg(F.max("pages").alias("pages"), parts.alias("parts"))
    entries = F.col("parts.entry")
    return listed.select(
        "doc_stem",
        F.lit(0).alias("page"),
        F.lit("header_footer").alias("trash_type"),
        F.lit(1.0).alias("confidence"),
        F.concat(
            F.lit("Repeated text stripped from "),
            F.col("pages").cast("string"),
            F.lit(" pages: "),
            F.array_join(entries, ", "),
        ).alias("reason"),
        tx.preview(tx.trim_ws(F.array_join(entries, "; "))).alias("preview"),
    )
