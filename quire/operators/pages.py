"""Operators on page rows: selection, cleanup, table shape, routing and bodies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed, text as tx
from quire.operators.keys import joined_facts
from quire.schemas import BLOCK_PAGES


@dataclass(frozen=True)
class Config:
    """Settings of a run, with their defaults."""

    language: str = "th"
    quality: str = "standard"
    table_extraction: bool = True
    page_as_image_threshold: float = 0.5
    min_image_size: int = 100
    max_retries: int = 3
    detect_trash: bool = True
    provider: str = fixed.FALLBACK_PROVIDER
    model: str = fixed.FALLBACK_MODEL


def page_range(pages: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Pages from ``start`` up to but not including ``end`` (0-based)."""
    kept = pages.where(F.col("page_num") >= start)
    return kept if end is None else kept.where(F.col("page_num") < end)


def cleanup_text(pages: DataFrame) -> DataFrame:
    """Replace ``text`` by its cleaned form."""
    return pages.withColumn("text", tx.cleanup(F.col("text")))


def looks_like_table(text: Column) -> Column:
    """Whether the lines of a page are laid out in columns.

    Either 40 % of the lines hold two gaps of spaces or tabs, or six lines in a row
    have three or more words and word counts that differ by at most two. Runs are
    found in a string with one mark per pair of neighbour lines, so lines stay in
    their row.
    """
    lines = F.filter(F.transform(tx.raw_lines(text), tx.trim_ws), lambda line: line != "")
    return tx.let(
        lines, lambda given: (F.size(given) >= 3) & (_has_wide_gaps(given) | _has_steady_rows(given))
    )


def _has_wide_gaps(lines: Column) -> Column:
    wide = F.filter(
        lines,
        # The plain searches keep the pattern off lines that cannot match.
        lambda line: (F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")))
        & (F.regexp_count(line, F.lit("[ \t]{2,}")) >= 2),
    )
    return F.size(wide) / F.size(lines) >= 0.4


def _has_steady_rows(lines: Column) -> Column:
    spaced = F.transform(lines, tx.collapse_spaces)
    words = F.transform(
        spaced,
        lambda line: F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1,
    )
    return tx.let(words, lambda counts: F.contains(_steady_marks(counts), F.lit("11111")))


def _steady_marks(counts: Column) -> Column:
    pairs = F.size(counts) - 1
    marks = F.zip_with(
        F.slice(counts, 1, pairs),
        F.slice(counts, 2, pairs),
        lambda a, b: F.when((a >= 3) & (b >= 3) & (F.abs(a - b) <= 2), "1").otherwise("0"),
    )
    return F.array_join(marks, "")


def flag_table_pages(pages: DataFrame) -> DataFrame:
    """Add ``is_table``."""
    return pages.withColumn("is_table", looks_like_table(F.col("text")))


def route_pages(
    pages: DataFrame, coverage: DataFrame, config: Config = Config(), block_pages: int = BLOCK_PAGES
) -> DataFrame:
    """Add ``strategy`` and ``table_candidate`` to cleaned pages.

    ``coverage`` has ``doc_stem, page_num, coverage``; a page without a row has none. Pages with
    ``block_no``, in blocks of ``block_pages``, are joined by block.
    """
    if config.quality.lower() == "high":
        return pages.withColumns(
            {
                "strategy": F.lit("high_quality"),
                "table_candidate": F.lit(False),
            }
        )
    share = F.coalesce(F.col("coverage"), F.lit(0.0))
    is_full = share >= config.page_as_image_threshold
    candidate = (
        F.when(is_full, F.lit(False)).otherwise(looks_like_table(F.col("text")))
        if config.table_extraction
        else F.lit(False)
    )
    return (
        joined_facts(pages, coverage.select("doc_stem", "page_num", "coverage"), block_pages)
        .withColumns(
            {
                "strategy": F.when(is_full, "full_page").otherwise("mixed"),
                "table_candidate": candidate,
            }
        )
        .drop("coverage")
    )


def page_heading() -> Column:
    """First part of a page body."""
    return F.concat(
        F.lit("\n\n---\n## Page "), (F.col("page_num") + 1).cast("string"), F.lit("\n")
    )


def text_body(text: Column) -> Column:
    """Body of a page that has text only."""
    return F.concat_ws("\n", page_heading(), F.when(text != "", text))


def failed_text(kind: str, error: Column) -> Column:
    """Text shown in place of a description that could not be made."""
    return F.concat(F.lit(fixed.FAILED_TEXT[kind]), error, F.lit("]"))


def assemble_pages(
    pages: DataFrame, descriptions: DataFrame | None = None, block_pages: int = BLOCK_PAGES
) -> DataFrame:
    """Body of each page: ``doc_stem, page_num, content``.

    ``pages`` are routed pages (or plain pages when ``descriptions`` is None, which
    gives text-only bodies); an ``error`` column, if present, replaces a failed page.
    ``descriptions`` has ``doc_stem, page_num, kind, index, image_ref, description``.
    """
    if descriptions is None:
        content = text_body(F.col("text"))
        joined = pages
    else:
        joined = joined_facts(pages, _page_descriptions(descriptions), block_pages)
        content = _described_body()
    if "error" in pages.columns:
        failed = F.concat(page_heading(), F.lit("[Error: "), F.col("error"), F.lit("]\n"))
        # The heading already ends its line, so the error follows without a joiner.
        content = F.when(F.col("error").isNotNull(), failed).otherwise(content)
    keys = [c for c in ("doc_stem", "page_num", "block_no") if c in pages.columns]
    return joined.select(*keys, content.alias("content"))


def _page_descriptions(descriptions: DataFrame) -> DataFrame:
    tag = F.concat(F.lit("[IMAGE:"), F.col("image_ref"), F.lit("]\n"))
    caption = F.concat(
        F.lit(f"**[{fixed.IMAGE_CAPTION_LABEL} "),
        F.col("index").cast("string"),
        F.lit("]:** "),
    )
    is_page = F.col("kind").isin("hq", "full")
    is_table = F.col("kind") == "table"
    image = F.concat(F.lit("\n"), tag, caption, F.col("description"), F.lit("\n"))
    return descriptions.groupBy("doc_stem", "page_num").agg(
        F.max(F.when(is_page, tag)).alias("_tag"),
        F.max(F.when(is_page, F.col("description"))).alias("_desc"),
        F.max(
            F.when(is_table, F.concat(F.lit("\n"), tag, F.lit("\n"), F.col("description"), F.lit("\n")))
        ).alias("_table"),
        F.sort_array(
            F.collect_list(F.when(F.col("kind") == "img", F.struct("index", image.alias("part"))))
        ).alias("_images"),
    )


def _described_body() -> Column:
    text = F.col("text")
    as_high = F.array(page_heading(), F.col("_tag"), F.col("_desc"))
    as_full = F.array(
        page_heading(), F.when(text != "", F.concat(text, F.lit("\n"))), F.col("_tag"), F.col("_desc")
    )
    as_mixed = F.concat(
        F.array(
            page_heading(),
            F.when(~F.col("table_candidate") & (text != ""), text),
            F.when(F.col("table_candidate"), F.col("_table")),
        ),
        F.coalesce(F.col("_images.part"), F.array().cast("array<string>")),
    )
    parts = (
        F.when(F.col("strategy") == "high_quality", as_high)
        .when(F.col("strategy") == "full_page", as_full)
        .otherwise(as_mixed)
    )
    # array_join leaves out the parts that are null.
    return F.array_join(parts, "\n")
