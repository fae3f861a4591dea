"""String expressions with the exact edge behaviour the text formats need."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace and line ends as Unicode-aware text tools understand them; the SQL
# ``trim`` removes spaces only.
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Decimal digits of any script, superscripts and subscripts.
LEADING_DIGIT = r"^[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def split_lines(text: Column) -> Column:
    """Stripped, non-empty lines of a text."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda line: line != "")


def clip(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def clip_marked(text: Column, length: int, mark: str) -> Column:
    """The first ``length`` characters, with a marker only if something was cut."""
    return F.when(F.char_length(text) > length, F.concat(clip(text, length), F.lit(mark))).otherwise(text)


def render(template: str, **fields: Column) -> Column:
    """Fill ``{name}`` places of a template with columns; null fields become empty text."""
    pieces = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            pieces.append(F.coalesce(fields[piece[1:-1]].cast("string"), F.lit("")))
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")
