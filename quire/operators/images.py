"""Images: coverage, selection, catalogue, tags in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed, text as tx
from quire.operators.keys import doc_keys, matched_per_document, rank_in_blocks


def image_coverage(objects: DataFrame) -> DataFrame:
    """Share of each page that image objects cover, at most 1; overlaps count twice."""
    area = F.abs(F.col("right") - F.col("left")) * F.abs(F.col("top") - F.col("bottom"))
    sums = objects.groupBy("doc_stem", "page_num").agg(
        F.max(F.col("page_w") * F.col("page_h")).alias("_page"),
        F.sum(F.when(F.col("kind") == "image", area).otherwise(0.0)).alias("_images"),
    )
    share = F.when(F.col("_page") == 0, 0.0).otherwise(
        F.least(F.col("_images") / F.col("_page"), F.lit(1.0))
    )
    return sums.select("doc_stem", "page_num", share.alias("coverage"))


def keep_large_images(
    objects: DataFrame, min_size: int = 100, block_width: int = 1024
) -> DataFrame:
    """Image objects at least ``min_size`` wide and high, numbered from 1 per page.

    The order is that of ``obj_idx``. ``block_width`` is the range of order values
    that is numbered in one window partition.
    """
    large = objects.where(
        (F.col("kind") == "image") & (F.col("px_w") >= min_size) & (F.col("px_h") >= min_size)
    )
    return rank_in_blocks(large, ["doc_stem", "page_num"], "obj_idx", "index", block_width)


def image_file(kind: Column, index: Column) -> Column:
    """Reference of an image: folder and file name by document, page and kind."""
    suffix = F.when(kind == "img", F.concat(F.lit("img"), index.cast("string"))).otherwise(kind)
    page = F.col("page_num") + 1
    number = F.when(page < 1000, F.lpad(page.cast("string"), 3, "0")).otherwise(page.cast("string"))
    return F.concat(
        F.col("doc_stem"), F.lit("/"), F.col("doc_stem"), F.lit("_page_"), number, F.lit("_"), suffix, F.lit(".png")
    )


def catalog_rows(described: DataFrame, provider: str = "", model: str = "") -> DataFrame:
    """Catalogue of described images.

    ``described`` has ``doc_stem, page_num, kind, index, width, height, description``
    with kind hq, full, table or img.
    """
    kind = F.col("kind")
    is_image = kind == "img"
    return described.select(
        "doc_stem",
        (F.col("page_num") + 1).alias("page"),
        F.when(is_image, F.col("index")).alias("index"),
        image_file(kind, F.col("index")).alias("image_file"),
        F.when(is_image, "extracted_image")
        .when(kind == "table", "table_region")
        .otherwise("full_page")
        .alias("type"),
        F.when(is_image, F.col("width")).alias("width"),
        F.when(is_image, F.col("height")).alias("height"),
        F.when(kind == "hq", tx.cut_bytes(F.col("description"), 200))
        .otherwise(F.col("description"))
        .alias("description"),
        F.col("doc_stem").alias("source_doc"),
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
    )


def remove_image_blocks(
    docs: DataFrame, deleted: DataFrame, only_listed: bool = False
) -> DataFrame:
    """Remove tags of deleted images with the description lines that follow them.

    Each line gets one letter: D deleted tag, B blank, S start of another block, O
    other. A removed block is a D, the O letters behind it and one B; the letters
    that belong to such a block are marked, and marked lines are left out. Lines are
    joined by a newline, without one at the end. With ``only_listed``, documents
    without a row in ``deleted`` keep their text as it is.
    """
    keys = doc_keys(docs)
    text = F.col("markdown")
    tags = F.regexp_extract_all("markdown", F.lit(r"\[IMAGE:([^\]\n]*)\]"), F.lit(1))
    named = deleted.select("doc_stem", "image_file")
    if only_listed:
        # A newline, which no tag holds, stands for the document itself.
        tags = F.array_append(tags, F.lit("\n"))
        named = named.select(
            "doc_stem", F.explode(F.array("image_file", F.lit("\n"))).alias("image_file")
        )
    hits = matched_per_document(docs, tags, named, "image_file", "_gone")
    new = _without_blocks(text, F.col("_gone"))
    if only_listed:
        new = F.when(F.col("_gone").isNull(), text).otherwise(new)
    return docs.join(hits, keys, "left").select(*keys, new.alias("markdown"))


def _without_blocks(markdown: Column, gone: Column) -> Column:
    def letter(line: Column) -> Column:
        trimmed = tx.trim_ws(line)
        named = F.regexp_extract(line, r"\[IMAGE:([^\]]*)\]", 1)
        has_tag = F.contains(line, F.lit("[IMAGE:")) & line.rlike(r"\[IMAGE:[^\]]*\]")
        return (
            F.when(has_tag & F.array_contains(gone, named), "D")
            .when(trimmed == "", "B")
            .when(
                trimmed.startswith("[IMAGE:") | trimmed.startswith("#") | trimmed.startswith("---"),
                "S",
            )
            .otherwise("O")
        )

    def without(lines: Column) -> Column:
        letters = F.array_join(F.transform(lines, letter), "")
        # \G continues directly behind the previous marked letter, so marking runs on
        # over O and stops after a B.
        marked = F.split(F.regexp_replace(letters, r"D|(?<=[DO])\G[OB]", "X"), "", -1)
        kept = F.zip_with(
            lines, F.slice(marked, 1, F.size(lines)), lambda line, m: F.when(m != "X", line)
        )
        # array_join leaves out nulls.
        return F.array_join(kept, "\n")

    lines = tx.text_lines(markdown)
    return F.when(gone.isNull(), F.array_join(lines, "\n")).otherwise(tx.let(lines, without))


def image_groups_html(docs: DataFrame, base_url: str, style: str = "html") -> DataFrame:
    """Turn image tags into ``<img>`` elements, or Markdown links with ``style='md'``.

    Adjacent tag lines form a group whose width depends on its size.
    """
    text = F.col("markdown")
    new = _as_links(text, base_url) if style == "md" else _as_html(text, base_url)
    return docs.select(*doc_keys(docs), new.alias("markdown"))


def _as_links(markdown: Column, base_url: str) -> Column:
    base = tx.escape_replacement(base_url)
    return F.regexp_replace(
        markdown, r"\[IMAGE:((?:[^\]]*/)?([^\]/]*))(?<!\[IMAGE:)\]", f"![$2]({base}/$1)"
    )


def _as_html(markdown: Column, base_url: str) -> Column:
    base = base_url.rstrip("/")
    # A tag line is a tag and white space, and names a non-empty path.
    is_tag = rf"\A{fixed.WS}*\[IMAGE:[^\n]+\]{fixed.WS}*\z"

    def letter(line: Column) -> Column:
        return F.when(F.contains(line, F.lit("[IMAGE:")) & line.rlike(is_tag), "I").otherwise("-")

    def render(line: Column, code: Column) -> Column:
        trimmed = tx.trim_ws(line)
        path = F.substring(trimmed, F.lit(8), F.length(trimmed) - 8)
        width = (
            F.when(code == "1", fixed.IMG_WIDTHS[1])
            .when(code.isin("2", "3"), fixed.IMG_WIDTHS[2])
            .when(code.isin("4", "5", "6"), fixed.IMG_WIDTHS[3])
            .otherwise(fixed.IMG_WIDTHS[4])
        )
        element = F.concat(
            F.when(code.isin("2", "4", "7"), fixed.IMG_WRAPPER_OPEN + "\n").otherwise(""),
            F.lit(f'<img src="{base}/'),
            path,
            F.lit('" style="'),
            width,
            F.lit(fixed.IMG_STYLE_TAIL + '">'),
            F.when(code.isin("3", "6", "9"), "\n" + fixed.IMG_WRAPPER_CLOSE).otherwise(""),
        )
        return F.when(code == "-", line).otherwise(element)

    def convert(lines: Column) -> Column:
        codes = F.split(_group_codes(F.array_join(F.transform(lines, letter), "")), "", -1)
        rendered = F.zip_with(lines, F.slice(codes, 1, F.size(lines)), render)
        return F.array_join(rendered, "\n")

    converted = tx.let(tx.text_lines(markdown), convert)
    ending = F.when(markdown.endswith("\n"), "\n").otherwise("")
    # Lines are only looked at where there is a tag at all.
    plain = F.array_join(tx.text_lines(markdown), "\n")
    body = F.when(F.contains(markdown, F.lit("[IMAGE:")), converted).otherwise(plain)
    return F.concat(body, ending)


def _group_codes(letters: Column) -> Column:
    """Digits that tell the place of a tag in its group of adjacent tags.

    A single tag is 1, a pair 23, a triple 456; longer groups start with 7, go on with
    8 and end with 9.
    """
    for pattern, code in [
        ("(?<!I)I(?!I)", "1"),
        ("(?<!I)II(?!I)", "23"),
        ("(?<!I)III(?!I)", "456"),
        ("(?<!I)I(?=I)", "7"),
        ("I(?!I)", "9"),
        ("I", "8"),
    ]:
        letters = F.regexp_replace(letters, pattern, code)
    return letters
