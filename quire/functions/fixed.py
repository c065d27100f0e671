# -*- coding: utf-8 -*-
"""Word lists, formats and lookup tables that outputs must reproduce."""

# Code points with the Unicode White_Space property.
WHITE_SPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680,
            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
        ],
    )
)

# Code points stripped by ECMAScript's String.prototype.trim.
ECMA_SPACE = "".join(sorted(set(WHITE_SPACE) - {"\x85"} | {"\ufeff"}))

# Regex class for WHITE_SPACE, and the same class without U+0020.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_NOT_SPACE = r"[\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_IN_LINE = r"[\t\x0b-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Words and marks that steer the line joiner.
SENTENCE_END_CHARS = ".!?:ๆ।"
SENTENCE_END_WORDS = ["ครับ", "ค่ะ", "นะคะ", "นะครับ"]
LINE_START_MARKS = ["- ", "* ", "• ", "# ", "> "]

# Headings of a contents page.
TOC_HEADING_EXACT = "สารบัญ"
TOC_HEADING_LOWER = "contents"

# Boilerplate keywords, in report order.
BOILERPLATE_KEYWORDS = [
    "copyright",
    "ลิขสิทธิ์",
    "all rights reserved",
    "สงวนลิขสิทธิ์",
    "disclaimer",
    "ข้อจำกัดความรับผิดชอบ",
    "terms of use",
    "terms and conditions",
    "ข้อกำหนดและเงื่อนไข",
    "confidential",
    "ความลับ",
]

# Markers of a deliberately blank page.
BLANK_MARKERS_LOWER = ["this page intentionally left blank", "intentionally blank"]
BLANK_MARKER_EXACT = "หน้านี้ว่างโดยตั้งใจ"

# Filter aliases and short labels of the detection types.
DETECTION_ALIASES = {
    "toc": "table_of_contents",
    "boilerplate": "boilerplate",
    "blank": "blank_page",
    "header_footer": "header_footer",
}
DETECTION_LABELS = {
    "table_of_contents": "TOC",
    "boilerplate": "Boilerplate",
    "blank_page": "Blank",
    "header_footer": "Header/Footer",
}
DETECTION_NAMES = {
    "table_of_contents": "Table of Contents",
    "boilerplate": "Boilerplate",
    "blank_page": "Blank page",
    "header_footer": "Header/Footer",
}

# Text put in place of a failed description, by image kind.
FAILED_TEXT = {
    "full": "[ไม่สามารถอธิบายภาพได้: ",
    "img": "[ไม่สามารถอธิบายภาพได้: ",
    "table": "[ไม่สามารถแปลงตารางได้: ",
    "hq": "[ไม่สามารถถอดข้อความได้: ",
}
IMAGE_CAPTION_LABEL = "ภาพที่"

# Markup written for image tags, by size of a run of adjacent tags.
IMG_WIDTHS = {
    1: "max-width:100%",
    2: "max-width:calc(50% - 4px)",
    3: "max-width:calc(33% - 6px)",
    4: "max-width:calc(25% - 6px)",
}
IMG_STYLE_TAIL = ";border-radius:8px;margin:8px 0;"
IMG_WRAPPER_OPEN = '<div style="display:flex;flex-wrap:wrap;gap:8px;margin:8px 0;">'
IMG_WRAPPER_CLOSE = "</div>"

# Provider registry (name, kind, default model, models, USD per image).
PROVIDERS = [
    ("ollama", "local", "qwen2.5vl",
     ["qwen2.5vl", "qwen2.5vl:72b", "llama3.2-vision", "minicpm-v"], 0.0),
    ("openai", "cloud", "gpt-4o", ["gpt-4o", "gpt-4o-mini"], 0.01),
    ("claude", "cloud", "claude-sonnet-4-6",
     ["claude-sonnet-4-6", "claude-haiku-4-5-20251001"], 0.01),
    ("gemini", "cloud", "gemini-2.0-flash",
     ["gemini-2.0-flash", "gemini-2.5-flash", "gemini-2.5-pro"], 0.0025),
    ("xai", "cloud", "grok-2-vision", ["grok-2-vision"], 0.005),
    ("groq", "cloud", "groq::llama-3.2-90b-vision-preview",
     ["groq::llama-3.2-90b-vision-preview", "groq::llama-3.2-11b-vision-preview"], 0.002),
]
FALLBACK_PROVIDER = "ollama"
FALLBACK_MODEL = "qwen2.5vl"

# MIME type by file name suffix, first match wins.
MIME_BY_SUFFIX = [
    (".png", "image/png"),
    (".jpg", "image/jpeg"),
    (".jpeg", "image/jpeg"),
    (".md", "text/markdown; charset=utf-8"),
    (".json", "application/json; charset=utf-8"),
]
MIME_DEFAULT = "application/octet-stream"

# Phases that end a progress feed.
TERMINAL_PHASES = ["complete", "error", "cancelled"]
