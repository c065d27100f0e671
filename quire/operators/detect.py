"""Detectors of low-value pages and operators on their results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed, text as tx

_COLUMNS = ["trash_type", "confidence", "reason", "preview"]


def _with_facts(pages: DataFrame) -> DataFrame:
    """What the detectors look at, computed once per page."""
    text = F.col("text")
    leaders = F.filter(
        tx.raw_lines(text),
        lambda line: (F.contains(line, F.lit("...")) | F.contains(line, F.lit("…")))
        & F.right(tx.trim_ws(line), F.lit(1)).between("0", "9"),
    )
    base = pages.select(
        "doc_stem",
        (F.col("page_num") + 1).alias("page"),
        "text",
        F.lower(text).alias("_lower"),
        tx.trim_ws(text).alias("_trimmed"),
        F.when(F.contains(text, F.lit("...")) | F.contains(text, F.lit("…")), F.size(leaders))
        .otherwise(0)
        .alias("_leaders"),
    )
    return base.withColumns(
        {
            "_hits": _keyword_hits(F.col("_lower")),
            "_preview": tx.preview(F.col("_trimmed")),
            "_n_bytes": F.octet_length("_trimmed"),
        }
    )


def _keyword_hits(lower: Column) -> Column:
    # Keywords have no capitals, so a hit in the text is a hit in its lower case too.
    # concat_ws skips the nulls of keywords that are absent.
    return F.concat_ws(
        ", ",
        *[
            F.when(F.contains(lower, F.lit(kw)), F.lit(kw))
            for kw in fixed.BOILERPLATE_KEYWORDS
        ],
    )


def _finding(kind: str, confidence: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("trash_type"),
        confidence.alias("confidence"),
        reason.alias("reason"),
        F.col("_preview").alias("preview"),
    )


def _toc() -> Column:
    leaders = F.col("_leaders")
    heading = F.contains("text", F.lit(fixed.TOC_HEADING_EXACT)) | F.contains(
        "_lower", F.lit(fixed.TOC_HEADING_LOWER)
    )
    confidence = (
        F.when(heading & (leaders >= 3), 0.95).when(heading, 0.90).when(leaders >= 5, 0.70)
    )
    reason = (
        F.when(
            heading & (leaders >= 3),
            F.concat(
                F.lit("TOC heading keyword found with "),
                leaders.cast("string"),
                F.lit(" dot-leader lines"),
            ),
        )
        .when(heading, F.lit("TOC heading keyword found"))
        .otherwise(
            F.concat(leaders.cast("string"), F.lit(" dot-leader lines detected (possible TOC)"))
        )
    )
    return F.when(confidence.isNotNull(), _finding("table_of_contents", confidence, reason))


def _boilerplate() -> Column:
    hits = F.col("_hits")
    several = F.contains(hits, F.lit(", "))
    n_bytes = F.octet_length("text")
    confidence = F.when(several, 0.85).when((hits != "") & (n_bytes < 500), 0.65)
    reason = F.when(several, F.concat(F.lit("Multiple boilerplate keywords: "), hits)).otherwise(
        F.concat(
            F.lit('Boilerplate keyword "'),
            hits,
            F.lit('" on short page ('),
            n_bytes.cast("string"),
            F.lit(" chars)"),
        )
    )
    return F.when(confidence.isNotNull(), _finding("boilerplate", confidence, reason))


def _blank() -> Column:
    marked = F.contains("text", F.lit(fixed.BLANK_MARKER_EXACT))
    for marker in fixed.BLANK_MARKERS_LOWER:
        marked = marked | F.contains("_lower", F.lit(marker))
    n_bytes = F.col("_n_bytes")
    confidence = F.when(marked, 0.95).when(n_bytes < 50, 0.80)
    reason = F.when(marked, F.lit("Explicit blank page marker found")).otherwise(
        F.concat(F.lit("Nearly blank page ("), n_bytes.cast("string"), F.lit(" chars)"))
    )
    return F.when(confidence.isNotNull(), _finding("blank_page", confidence, reason))


def _detect(pages: DataFrame, *findings: Column) -> DataFrame:
    # The generator keeps the null test from being pushed into the projections below,
    # which would copy every expression into a filter.
    rows = _with_facts(pages).select("doc_stem", "page", F.explode(F.array(*findings)).alias("_found"))
    return rows.where(F.col("_found").isNotNull()).select(
        "doc_stem", "page", *[F.col(f"_found.{c}").alias(c) for c in _COLUMNS]
    )


def detect_toc(pages: DataFrame) -> DataFrame:
    """Table-of-contents pages, by heading word and dot-leader lines."""
    return _detect(pages, _toc())


def detect_boilerplate(pages: DataFrame) -> DataFrame:
    """Legal and other boilerplate pages, by keywords."""
    return _detect(pages, _boilerplate())


def detect_blank(pages: DataFrame) -> DataFrame:
    """Blank and nearly blank pages."""
    return _detect(pages, _blank())


def detect_trash(pages: DataFrame) -> DataFrame:
    """All three page detectors in one pass: 0 to 3 rows per page."""
    return _detect(pages, _toc(), _boilerplate(), _blank())


def all_detections(pages: DataFrame, hf: DataFrame) -> DataFrame:
    """Page detections and the header/footer row of each document."""
    from quire.operators.boilerplate import header_footer_detection

    return detect_trash(pages).unionByName(header_footer_detection(hf))


def filter_detections(
    det: DataFrame, aliases: Iterable[str] | str | None = None, review: bool = False
) -> DataFrame:
    """Detections of removable pages, narrowed to type aliases.

    Document rows (page 0) are never removable. An unknown alias matches nothing;
    None keeps every type. ``review`` leaves out header/footer rows altogether.
    """
    kept = det.where(F.col("page") > 0)
    if review:
        kept = kept.where(F.col("trash_type") != "header_footer")
    if aliases is None:
        return kept
    names = aliases.split(",") if isinstance(aliases, str) else list(aliases)
    types = [fixed.DETECTION_ALIASES[n.strip()] for n in names if n.strip() in fixed.DETECTION_ALIASES]
    return kept.where(F.col("trash_type").isin(types)) if types else kept.where(F.lit(False))


def detection_summary(det: DataFrame) -> DataFrame:
    """Number of detections per document and type, with the type's display name."""
    names = F.create_map(*[F.lit(v) for pair in fixed.DETECTION_NAMES.items() for v in pair])
    return (
        det.groupBy("doc_stem", "trash_type")
        .agg(F.count(F.lit(1)).alias("detections"))
        .withColumn("type_name", names[F.col("trash_type")])
    )


def remove_detections(det: DataFrame, removals: DataFrame) -> DataFrame:
    """Drop detections of removed pages; rows without a page stay."""
    gone = removals.select("doc_stem", "page").distinct()
    return det.join(gone, ["doc_stem", "page"], "left_anti")
