"""Columns of paths: normal form, parts and the language that a name stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import LANGUAGES, STYLES, by_extension, by_name


def normalized(path: Column) -> Column:
    """Forward slashes; an empty path is '.'."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p == "", F.lit(".")).otherwise(p)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder, '' at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """After the last dot of the name; null without one, or where that dot begins the name."""
    found = F.regexp_extract(base_name(path), "(?s)^.+\\.([^.]*)$", 1)
    return F.when(base_name(path).rlike("(?s)^.+\\.[^.]*$"), found)


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A constant map: folded into the plan, so no join and no shuffle."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]), key)


def language(path: Column) -> Column:
    """By whole name first, then by extension; null where neither is known."""
    return F.coalesce(_lookup(by_name(), base_name(path)), _lookup(by_extension(), extension(path)))


def style_of(language_: Column) -> Column:
    """Name of the language's comment style."""
    return _lookup({name: x.style for name, x in LANGUAGES.items()}, language_)


def has_blocks(language_: Column) -> Column:
    """Whether comments of the language can span lines."""
    return language_.isin(sorted(name for name, x in LANGUAGES.items() if STYLES[x.style].start))


def single_token(language_: Column) -> Column:
    """The token that opens a comment up to the end of the line, if the language has one."""
    return _lookup({name: t for name, x in LANGUAGES.items() if (t := STYLES[x.style].single)}, language_)
