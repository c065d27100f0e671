"""From page bodies to Markdown documents, and figures about documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.keys import document_blocks, whole_documents, with_block
from quire.schemas import BLOCK_PAGES

PAGE_LINE = r"(?:^|\n)## Page ([0-9]+)"


def text_only_head(language: str, title: Column | None = None) -> Column:
    """Title and mode lines of a text-only document; ``title`` stands for ``doc_stem`` where that is not its name."""
    label = language.lower() if language.lower() in ("th", "en") else "th"
    return F.concat(
        F.lit("# "),
        F.col("doc_stem") if title is None else title,
        F.lit(f"\n\n> Mode: `text-only` | Language: `{label}` | Pages: "),
        F.col("pages").cast("string"),
        F.lit("\n"),
    )


def vision_head(provider: str, model: str, quality: str) -> Column:
    """Title, provider and image folder lines of a described document."""
    label = "high (vision-first)" if quality.lower() == "high" else "standard"
    return F.concat(
        F.lit("# "),
        F.col("doc_stem"),
        F.lit(f"\n\n> Provider: `{provider}` | Model: `{model}` | Quality: `{label}` | Pages: "),
        F.col("pages").cast("string"),
        F.lit("\n\n> Images: `images/"),
        F.col("doc_stem"),
        F.lit("/`\n"),
    )


def assemble_documents(
    bodies: DataFrame,
    head: Column,
    pages: DataFrame | None = None,
    block_pages: int = BLOCK_PAGES,
) -> DataFrame:
    """Markdown per page block: ``doc_stem, block_no, markdown``.

    A document of at most ``block_pages`` pages is one row. A longer one goes on in
    further rows, each starting at a page header, and its text is its rows joined by
    a newline (``keys.whole_documents``). ``head`` may use
    ``doc_stem`` and ``pages``. ``pages`` is any table with the same page keys that
    is cheaper to count than ``bodies``.
    """
    blocks = document_blocks(bodies if pages is None else pages, block_pages)
    texts = (
        with_block(bodies, block_pages)
        .groupBy("doc_stem", "block_no")
        .agg(F.sort_array(F.collect_list(F.struct("page_num", "content"))).alias("_pages"))
    )
    text = F.array_join(F.col("_pages.content"), "\n")
    # A page's rule stands before its header. A row starts at the header, so the rule
    # of the next row's first page closes this row.
    body = F.when(F.col("block_no") == 0, text).otherwise(F.regexp_replace(text, r"\A\n\n---\n", ""))
    closing = F.when(F.col("block_no") < F.col("last_block"), F.lit("\n\n---"))
    opening = F.when(F.col("block_no") == 0, head)
    return texts.join(blocks, ["doc_stem", "block_no"], "left").select(
        "doc_stem", "block_no", F.concat_ws("\n", opening, body, closing).alias("markdown")
    )


def document_stats(docs: DataFrame, catalog: DataFrame, det: DataFrame) -> DataFrame:
    """Pages, last page, images, detections and size in KB of each document."""
    numbers = F.regexp_extract_all("markdown", F.lit(PAGE_LINE), F.lit(1))
    per_row = docs.select(
        "doc_stem",
        F.size(numbers).cast("long").alias("n"),
        F.array_max(F.transform(numbers, lambda x: x.try_cast("bigint"))).alias("last"),
        F.octet_length("markdown").cast("long").alias("bytes"),
    )
    rows = per_row.groupBy("doc_stem").agg(
        F.sum("n").alias("page_sections"),
        F.coalesce(F.max("last"), F.lit(0)).cast("long").alias("last_page"),
        F.sum("bytes").alias("_bytes"),
        F.count(F.lit(1)).alias("_rows"),
    )
    images = catalog.groupBy("doc_stem").agg(F.count(F.lit(1)).alias("images"))
    found = det.groupBy("doc_stem").agg(F.count(F.lit(1)).alias("detections"))
    # Rows of a long document are joined by one newline each.
    size = F.col("_bytes") + F.col("_rows") - 1
    return (
        rows.join(images, "doc_stem", "left")
        .join(found, "doc_stem", "left")
        .select(
            "doc_stem",
            "page_sections",
            "last_page",
            F.coalesce("images", F.lit(0)).alias("images"),
            F.coalesce("detections", F.lit(0)).alias("detections"),
            F.round(size / 1024.0, 1).alias("size_kb"),
        )
    )


def results_view(jobs: DataFrame, docs: DataFrame, catalog: DataFrame, det: DataFrame) -> DataFrame:
    """Completed jobs with Markdown, catalogue and detections nested beside them.

    One row per job. Missing outputs are null and count zero. Outputs of documents
    without a job are left out before they are gathered.
    """
    done = jobs.where(F.col("status") == "completed").select(
        F.col("id").alias("job_id"), F.regexp_replace("filename", r"\.pdf\z", "").alias("doc_stem")
    )
    named = done.select("doc_stem").distinct()

    def nested(table: DataFrame, out: str) -> DataFrame:
        fields = [c for c in table.columns if c != "doc_stem"]
        rows = F.sort_array(F.collect_list(F.struct(*fields)))
        return table.join(named, "doc_stem", "left_semi").groupBy("doc_stem").agg(rows.alias(out))

    texts = whole_documents(docs.join(named, "doc_stem", "left_semi")).select("doc_stem", "markdown")
    return (
        done.join(texts, "doc_stem", "left")
        .join(nested(catalog, "metadata"), "doc_stem", "left")
        .join(nested(det, "trash"), "doc_stem", "left")
        .select(
            "job_id",
            "markdown",
            "metadata",
            F.when(F.col("metadata").isNull(), 0).otherwise(F.size("metadata")).alias("image_count"),
            "trash",
            F.when(F.col("trash").isNull(), 0).otherwise(F.size("trash")).alias("trash_count"),
        )
    )


def purge_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in ``ids``."""
    gone = ids.select("doc_stem").distinct()
    return {name: table.join(gone, "doc_stem", "left_anti") for name, table in tables.items()}
