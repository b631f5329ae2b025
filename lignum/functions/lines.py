"""Columns of lines. LF, CR LF and a lone CR end a line; an ending at the very end opens no further one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space in a line: not the vertical tab.
BLANK = "[ \\t\\f]*"
_LATIN = "ISO-8859-1"


def as_latin(content: Column) -> Column:
    """Bytes as text, one character each, so that any file can be matched in the JVM."""
    return F.decode(content, _LATIN)


def lines(text: Column) -> Column:
    """Array of the lines of a text."""
    parts = F.split(text, "\r\n|\r|\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def unix(text: Column) -> Column:
    """The text with LF for each line end."""
    return F.regexp_replace(text, "\r\n?", "\n")


def has_long_line(text: Column, most: int) -> Column:
    """Whether some line has more than `most` characters."""
    return F.regexp_like(text, F.lit(f"(?<![^\\r\\n])[^\\r\\n]{{{most + 1}}}"))  # tried at the begin of lines alone
