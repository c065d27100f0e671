"""Schemas of the tables that operators exchange."""

from __future__ import annotations

PAGE_TEXTS = "doc_stem string, page_num int, text string"

PAGE_OBJECTS = (
    "doc_stem string, page_num int, obj_idx bigint, kind string, page_w double, page_h double, "
    "left double, right double, top double, bottom double, px_w int, px_h int"
)

CATALOG = (
    "doc_stem string, page int, index int, image_file string, type string, width int, height int, "
    "description string, source_doc string, provider string, model string"
)

DETECTIONS = (
    "doc_stem string, page int, trash_type string, confidence double, reason string, preview string"
)

JOB_CONFIG = (
    "provider string, model string, language string, start_page int, end_page int, "
    "table_extraction boolean, text_only boolean, storage string, s3_bucket string, "
    "s3_prefix string, storage_path string, quality string, dpi int, notify boolean, "
    "enhance boolean"
)

PROVIDERS = (
    "name string, kind string, default_model string, models array<string>, "
    "cost_per_image_usd double"
)

# One row of a document's Markdown. A document of at most `block_pages` pages is one row;
# a longer one continues in rows of rising block_no, each starting at a page header.
MARKDOWN_DOCS = "doc_stem string, block_no int, markdown string"
BLOCK_PAGES = 512
