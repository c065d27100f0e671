"""Text formulas: trimming, lines, byte cuts and the paragraph joiner.

Everything here is a ``Column -> Column`` built from JVM expressions, so the
operators that use it stay narrow and never start a Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import fixed


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    Spark does not share expressions that occur inside the arguments of array functions.
    """
    return F.get(F.transform(F.array(value), use), 0)


def trim_ws(c: Column) -> Column:
    """Strip Unicode white space at both ends (Spark's ``trim`` only strips U+0020)."""
    return F.btrim(c, F.lit(fixed.WHITE_SPACE))


def trim_ecma(c: Column) -> Column:
    """Strip the white space and line ends that a browser's ``trim`` strips."""
    return F.btrim(c, F.lit(fixed.ECMA_SPACE))


def raw_lines(c: Column) -> Column:
    """Pieces between ``\\n``; a final newline gives a last empty piece."""
    return F.split(c, "\n", -1)


def without_last_newline(c: Column) -> Column:
    """Text without its final ``\\n``, which adds no line of its own."""
    return F.when(c.endswith("\n"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def text_lines(c: Column) -> Column:
    """Lines ended by ``\\n`` or ``\\r\\n``; a final line end adds no empty line."""
    # The pattern for two kinds of line ends is only used where there are two kinds.
    unix = F.when(F.contains(c, F.lit("\r\n")), F.regexp_replace(c, "\r\n", "\n")).otherwise(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(
        F.split(without_last_newline(unix), "\n", -1)
    )


def cut_bytes(c: Column, limit: int) -> Column:
    """Longest prefix of at most ``limit`` UTF-8 bytes that ends on a character."""
    raw = c.cast("binary")

    def starts_char(pos: int) -> Column:
        following = F.substring(raw, pos + 1, 1)
        return (following < F.lit(b"\x80")) | (following >= F.lit(b"\xc0"))

    cuts = [
        F.when(starts_char(pos), F.substring(raw, 1, pos).cast("string"))
        for pos in range(limit, max(limit - 4, 0), -1)
    ]
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.coalesce(*cuts))


def preview(trimmed: Column, limit: int = 200) -> Column:
    """Preview of an already trimmed text, with an ellipsis when it was cut."""
    return F.when(F.octet_length(trimmed) <= limit, trimmed).otherwise(
        F.concat(cut_bytes(trimmed, limit), F.lit("..."))
    )


# Cheap first tests: printable ASCII and the letters up to U+167F cannot start a match,
# so ordinary text never reaches the long white space class.
_NOT_PLAIN = r"[^ -~\x{a1}-\x{167f}]"
_SPACE_RUN = rf"(?=[^!-~\x{{a1}}-\x{{167f}}])(?:{fixed.WS}{{2,}}|{fixed.WS_NOT_SPACE})"


def collapse_spaces(trimmed: Column) -> Column:
    """Runs of white space inside a trimmed line become one space."""
    has_run = F.contains(trimmed, F.lit("  ")) | trimmed.rlike(_NOT_PLAIN)
    return F.when(has_run, F.regexp_replace(trimmed, _SPACE_RUN, " ")).otherwise(trimmed)


def _tidy_line(trimmed: Column) -> Column:
    """Collapse spaces, except in a line of three or more cells set apart by two spaces."""
    collapsed = F.regexp_replace(trimmed, _SPACE_RUN, " ")
    cells = F.filter(F.split(trimmed, "  ", -1), lambda cell: trim_ws(cell) != "")
    return (
        F.when(
            F.contains(trimmed, F.lit("  ")), F.when(F.size(cells) >= 3, trimmed).otherwise(collapsed)
        )
        .when(trimmed.rlike(_NOT_PLAIN), collapsed)
        .otherwise(trimmed)
    )


# A newline between two non-blank lines becomes a space unless the line before it
# ends a sentence or the line after it opens a list item, heading, quote or number.
# The newline comes first in the pattern, so the look-behinds are tried at line ends only.
_JOINABLE_NEWLINE = (
    f"\n(?<![{fixed.SENTENCE_END_CHARS}\n]\n)"
    + "".join(f"(?<!{word}\n)" for word in fixed.SENTENCE_END_WORDS)
    + "(?!\n|" + "|".join(re.escape(mark) for mark in fixed.LINE_START_MARKS) + "|[0-9][^\n]*\\. )"
)


def cleanup(text: Column) -> Column:
    """Join broken lines into paragraphs and normalise the space inside lines.

    Whether a line is joined depends on its direct neighbours only, so no state has
    to be carried down the page: lines are normalised one by one, and three
    linear-time replacements over the whole text place the joiners.
    """
    normal = F.transform(F.transform(raw_lines(text), trim_ws), _tidy_line)
    body = F.btrim(F.array_join(normal, "\n"), F.lit("\n"))
    joined = F.regexp_replace(body, _JOINABLE_NEWLINE, " ")
    return F.when(
        F.contains(joined, F.lit("\n\n\n")), F.regexp_replace(joined, "\n{3,}", "\n\n")
    ).otherwise(joined)


def escape_regex(literal: str) -> str:
    """Escape a literal for a Java pattern without ``\\Q..\\E``."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|&~#" else ch for ch in literal)


def literal_pattern(literal: str, case_sensitive: bool) -> str:
    """Pattern of a literal; case folding keeps ASCII letters apart from look-alikes."""
    if case_sensitive:
        return escape_regex(literal)
    parts = []
    for ch in literal:
        if ch.isascii() and ch.isalpha():
            parts.append(f"[{ch.lower()}{ch.upper()}]")
        elif ch.isascii():
            parts.append(escape_regex(ch))
        else:
            parts.append(f"(?iu:{ch})")
    return "".join(parts)


def escape_replacement(text: str) -> str:
    """Escape a literal for the replacement side of ``regexp_replace``."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def mime_type(name: Column) -> Column:
    """MIME type from the suffix of a file name."""
    out = F.lit(fixed.MIME_DEFAULT)
    for suffix, mime in reversed(fixed.MIME_BY_SUFFIX):
        out = F.when(name.endswith(suffix), F.lit(mime)).otherwise(out)
    return out


def public_url(base: str, path: Column, prefix: str = "") -> Column:
    """Public address of a stored object: base, optional key prefix, path."""
    key = F.concat(F.lit(prefix.rstrip("/") + "/"), path) if prefix else path
    return F.concat(F.lit(base.rstrip("/") + "/"), key)
