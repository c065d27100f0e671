"""Markdown as a table: sections, removals, edits, search and replace.

A document row is cut into sections inside the row, so these operators shuffle a
document at most once, to meet the requests that concern it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed, text as tx
from quire.operators.keys import doc_keys, matched_per_document, whole_documents

# Section header of the review screen: at column 0, digits may be followed by more.
_REVIEW_CUT = r"\n(?=## Page [0-9])"
# A page number fits 32 bits: up to nine digits, or ten up to 4294967295.
_LIMIT = "4294967295"
_UP_TO_U32 = "|".join(
    ["[0-9]{1,9}", _LIMIT]
    + [f"{_LIMIT[:i]}[0-{int(d) - 1}][0-9]{{{9 - i}}}" for i, d in enumerate(_LIMIT) if d != "0" and i]
    + ["[1-3][0-9]{9}"]
)
# Page header of the cleaner: trimmed, and nothing but the number after the words.
_CLEAN_HEADER = rf"{fixed.WS_IN_LINE}*## Page {fixed.WS_IN_LINE}*\+?0*({_UP_TO_U32}){fixed.WS_IN_LINE}*"
# The newline comes first, so the header is tried at line ends only.
_CLEAN_CUT = rf"\n(?={_CLEAN_HEADER}(?:\n|\z))"
_CLEAN_START = rf"\A{_CLEAN_HEADER}(?:\n|\z)"


def _review_sections(markdown: Column) -> Column:
    return F.split(markdown, _REVIEW_CUT, -1)


def _header_line(section: Column) -> Column:
    return F.when(
        section.rlike(r"\A## Page [0-9]"), F.substring_index(section, "\n", 1)
    ).otherwise(F.lit(""))


def _page_of_header(header: Column) -> Column:
    number = F.regexp_extract(header, r"\A## Page ([0-9]+)", 1)
    return F.coalesce(number.try_cast("bigint"), F.lit(0)).cast("bigint")


def split_sections(docs: DataFrame) -> DataFrame:
    """One row per section: head first (page 0), then one per ``## Page N`` header."""
    docs = whole_documents(docs)
    keys = doc_keys(docs)
    cut = docs.select(*keys, F.posexplode(_review_sections(F.col("markdown"))).alias("section_no", "content"))
    headed = cut.withColumn("header", _header_line(F.col("content")))
    rest = F.substring(F.col("content"), F.length("header") + 2, F.length("content"))
    body = F.when(rest.startswith("---"), F.substring(rest, F.lit(4), F.length("content"))).otherwise(rest)
    return headed.select(
        *keys,
        "section_no",
        _page_of_header(F.col("header")).alias("page_number"),
        "header",
        "content",
        tx.trim_ecma(F.when(F.col("header") == "", F.col("content")).otherwise(body)).alias("raw_content"),
    )


def label_sections(sections: DataFrame, det: DataFrame) -> DataFrame:
    """Add ``label``: short name of the last detection of the section's page, if any."""
    kind = F.col("trash_type")
    label, order = kind, F.lit(-1)
    # Detections of a page are listed in the order of this table.
    for place, (name, short) in enumerate(fixed.DETECTION_LABELS.items()):
        label = F.when(kind == name, F.lit(short)).otherwise(label)
        order = F.when(kind == name, F.lit(place)).otherwise(order)
    last = det.groupBy("doc_stem", F.col("page").cast("bigint").alias("page_number")).agg(
        F.max_by(label, order).alias("label")
    )
    return sections.join(last, ["doc_stem", "page_number"], "left")


def _unix_lines(markdown: Column) -> Column:
    return F.replace(markdown, F.lit("\r\n"), F.lit("\n"))


def _clean_text(markdown: Column) -> Column:
    """Line ends as the cleaner writes them: ``\\n`` after every line."""
    unix = _unix_lines(markdown)
    return F.when((unix == "") | unix.endswith("\n"), unix).otherwise(F.concat(unix, F.lit("\n")))


def _clean_page(section: Column) -> Column:
    return F.regexp_extract(section, _CLEAN_START, 1).try_cast("bigint")


def remove_pages(
    docs: DataFrame, removals: DataFrame, only_listed: bool = False, own_pages: bool = False
) -> DataFrame:
    """Drop the sections of listed pages; the head stays, every line ends in a newline.

    With ``only_listed``, documents without a row in ``removals`` keep their text as it is. With ``own_pages``,
    ``removals`` were found on the documents' own pages, so there are no more than those: they are gathered as they are,
    and the texts, which need not tell which pages they have, are made once.
    """
    docs = whole_documents(docs)
    keys = doc_keys(docs)
    unix = _unix_lines(F.col("markdown"))
    # Sections without the newline at their end.
    sections = F.split(tx.without_last_newline(unix), _CLEAN_CUT, -1)
    wanted = removals.select("doc_stem", F.col("page").cast("bigint").alias("page"))
    if own_pages:
        hits = wanted.groupBy("doc_stem").agg(F.collect_set("page").alias("_gone"))
    else:
        pages = F.array_compact(F.transform(sections, _clean_page))
        if only_listed:
            # Page -1 stands for the document itself, so one pass over the removals tells
            # both which pages go and which documents are listed at all.
            pages = F.array_append(pages, F.lit(-1).cast("bigint"))
            wanted = wanted.select("doc_stem", F.explode(F.array("page", F.lit(-1))).alias("page"))
        hits = matched_per_document(docs, pages, wanted, "page", "_gone")
    # A section without a page number is the head; it is never in the list.
    kept = F.filter(
        sections, lambda s: ~F.coalesce(F.array_contains(F.col("_gone"), _clean_page(s)), F.lit(False))
    )
    ended = lambda left: F.when((unix == "") | (F.size(left) == 0), F.lit("")).otherwise(
        F.concat(F.array_join(left, "\n"), F.lit("\n"))
    )
    unmatched = F.col("markdown") if only_listed else _clean_text(F.col("markdown"))
    new = F.when(F.col("_gone").isNull(), unmatched).otherwise(tx.let(kept, ended))
    return docs.join(hits, keys, "left").select(*keys, new.alias("markdown"))


def apply_section_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply a batch of section edits: ``doc_stem, page, action, content, new_pos, seq``.

    Actions are delete, replace and move. All refer to the sections as they were
    before the batch; ``new_pos`` is the 0-based place a section moves to. Of several
    edits of one kind on a page the one of the highest ``seq`` wins; a deleted page stays
    deleted. Sections are joined by a newline.
    """
    docs = whole_documents(docs)
    keys = doc_keys(docs)
    action = F.col("action")
    seq = F.col("seq") if "seq" in edits.columns else F.lit(0)
    per_page = edits.groupBy("doc_stem", F.col("page").cast("bigint").alias("page")).agg(
        F.max(action == "delete").alias("gone"),
        F.max_by("content", F.when(action == "replace", F.struct(seq, F.col("content")))).alias("text"),
        F.max_by("new_pos", F.when(action == "move", F.struct(seq, F.col("new_pos")))).alias("place"),
    )
    sections = _review_sections(F.col("markdown"))
    numbers = F.transform(sections, lambda s: _page_of_header(_header_line(s)))
    hits = matched_per_document(docs, numbers, per_page, "page", "_edits", "gone", "text", "place")

    def edited(section: Column, position: Column) -> Column:
        header = _header_line(section)
        edit = F.get(F.filter(F.col("_edits"), lambda e: e["page"] == _page_of_header(header)), 0)
        text = F.when(
            edit["text"].isNotNull(),
            F.concat(F.when(header == "", F.lit("")).otherwise(F.concat(header, F.lit("\n---\n"))), edit["text"]),
        ).otherwise(section)
        # A section moved down lands behind the one whose place it takes, else before it.
        shift = F.when(edit["place"] > position, 0.5).otherwise(-0.5)
        place = F.when(
            edit["place"].isNull() | (edit["place"] == position), position.cast("double")
        ).otherwise(edit["place"] + shift)
        return F.struct(
            place.alias("place"),
            position.alias("position"),
            text.alias("text"),
            F.coalesce(edit["gone"], F.lit(False)).alias("gone"),
        )

    kept = F.filter(F.transform(sections, edited), lambda s: ~s["gone"])
    new_text = F.array_join(F.sort_array(kept)["text"], "\n")
    return docs.join(hits, keys, "left").select(
        *keys,
        F.when(F.col("_edits").isNull(), F.col("markdown")).otherwise(new_text).alias("markdown"),
    )


def search_corpus(docs: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Every non-overlapping match of a literal: ``match_no, offset, length``.

    Offsets count code points from the start of the document. The text is cut at
    the matches inside its row; only the lengths of the pieces are shuffled.
    """
    docs = whole_documents(docs)
    keys = doc_keys(docs)
    if not query:
        return docs.select(
            *keys, F.lit(0).alias("match_no"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("length")
        ).where(F.lit(False))
    pieces = F.split("markdown", tx.literal_pattern(query, case_sensitive), -1)
    lengths = F.transform(pieces, lambda p: F.length(p))
    # The piece after the last match is of no use.
    before = F.slice(lengths, 1, F.size(lengths) - 1)
    parts = docs.select(*keys, F.posexplode(before).alias("pos", "piece"))
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return parts.select(
        *keys,
        (F.col("pos") + 1).alias("match_no"),
        (F.sum("piece").over(so_far) + F.col("pos") * len(query)).alias("offset"),
        F.lit(len(query)).alias("length"),
    )


def count_matches(docs: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Number of matches per document."""
    docs = whole_documents(docs)
    pattern = F.lit(tx.literal_pattern(query, case_sensitive))
    return docs.select(*doc_keys(docs), F.regexp_count("markdown", pattern).alias("matches"))


def replaced(source: Column, query: str, text: str, case_sensitive: bool = False) -> Column:
    """A text with every match of a literal replaced by a literal."""
    if not query:
        return source
    if case_sensitive:
        return F.replace(source, F.lit(query), F.lit(text))
    return F.regexp_replace(source, tx.literal_pattern(query, False), tx.escape_replacement(text))


def replace_corpus(
    docs: DataFrame, query: str, text: str, case_sensitive: bool = False
) -> DataFrame:
    """Replace every match of a literal by a literal in all documents."""
    docs = whole_documents(docs)
    new = replaced(F.col("markdown"), query, text, case_sensitive)
    return docs.select(*doc_keys(docs), new.alias("markdown"))


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks for an index: ``doc_stem, part_no, piece_no, content``.

    A document is cut at its lines ``---``, which stand between pages, so that image tags stay
    with the text around them. A longer part is cut into pieces of ``size`` characters,
    each starting ``overlap`` before the end of the last. Blank parts are left out.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    docs = whole_documents(docs)
    keys = doc_keys(docs)
    text = F.concat(F.lit("\n"), "markdown", F.lit("\n"))
    parts = docs.select(*keys, F.posexplode(F.split(text, "\n---\n", -1)).alias("part_no", "part"))
    last = F.greatest(F.char_length("part") - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    pieces = parts.where(F.col("part").rlike(r"[^\s]")).select(
        *keys, "part_no", "part", F.posexplode(starts).alias("piece_no", "start")
    )
    content = F.substring(F.col("part"), F.col("start") + 1, F.lit(size))
    return pieces.select(*keys, "part_no", "piece_no", content.alias("content"))


def chunk_image_integrity(chunks: DataFrame) -> DataFrame:
    """Chunks with an image tag that has no description in them.

    After such a tag comes nothing, or another tag, or the chunk ends inside it.
    """
    return chunks.where(F.col("content").rlike(r"\[IMAGE:[^\]\n]*(?:\z|\]\s*(?:\z|\[IMAGE:))"))
