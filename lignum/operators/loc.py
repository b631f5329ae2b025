"""Code, comment and empty lines.

A line is code if anything but white space lies outside comments, else comment
if any of it is, else empty; blank lines inside a block comment are empty.
Blocks nest unless both their tokens are the same. Strings aren't recognised.

Languages without block comments are counted by JVM expressions. For the
others one Arrow function takes the bytes; it gets null where the JVM counts,
so only files that need it travel to Python, in the same pass over the table.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lines as L
from ..functions import paths
from ..registry import LANGUAGES, STYLES, Style

COUNTS = ("code_lines", "comment_lines", "empty_lines")
SUMS = (*COUNTS, "size_bytes")
_COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_ENDS = re.compile(rb"\r\n|\r|\n")
_WHITE = b" \t\f\r\n"


def split_lines(data: bytes) -> list[bytes]:
    parts = _ENDS.split(data)
    return parts if parts[-1] else parts[:-1]


@functools.cache
def _searches(style: Style) -> tuple[re.Pattern[bytes] | None, re.Pattern[bytes] | None, bytes | None, bytes | None]:
    """What to look for outside and inside a block, and the tokens that start and end one."""
    single, start, end = (t.encode() if t else None for t in style)
    # at the same place the longer token wins, the block's start if they are as long
    opening = sorted((t for t in (start, single) if t), key=len, reverse=True)
    closing = [t for t in (end, start if start != end else None) if t]
    either = lambda tokens: re.compile(b"|".join(map(re.escape, tokens))) if tokens else None
    return either(opening), either(closing), start, end


def count_lines(data: bytes, style: Style) -> tuple[int, int, int]:
    """(code, comment, empty) lines of a file."""
    outside, inside, start, end = _searches(style)
    totals = [0, 0, 0]
    depth = 0
    for line in split_lines(data):
        at, code, comment = 0, False, False
        while at < len(line):
            token = inside if depth else outside
            m = token.search(line, at) if token else None
            if line[at : m.start() if m else len(line)].strip(_WHITE):
                comment, code = comment or depth > 0, code or depth == 0
            if m is None:
                break
            comment, at = True, m.end()
            if depth:
                depth += -1 if m[0] == end else 1
            elif m[0] == start:
                depth = 1
            else:
                break
        totals[0 if code else 1 if comment else 2] += 1
    return totals[0], totals[1], totals[2]


@F.arrow_udf(_COUNTS)
def _scanned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for contents, languages in batches:
        found = [None if c is None or g is None else dict(zip(COUNTS, count_lines(c, STYLES[LANGUAGES[g].style]))) for c, g in zip(contents.to_pylist(), languages.to_pylist())]
        yield pa.array(found, pa.struct([(c, pa.int64()) for c in COUNTS]))


def _native(text: Column, language: Column) -> dict[str, Column]:
    """Lines of a text whose lines end in LF, where no comment spans lines; null for null."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    empty = F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit(f"(?md)^{L.BLANK}$")))
    token, comment = paths.single_token(language), F.when(text.isNotNull(), 0)
    # a constant pattern for each token, so that none is compiled by the row
    for t in sorted({x.single for x in STYLES.values() if x.single and not x.start}):
        comment = F.when(token == t, F.regexp_count(text, F.lit(f"(?md)^{L.BLANK}\\Q{t}\\E"))).otherwise(comment)
    return {"total": ends + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0), "comment": comment, "empty": empty}


def with_counts(files: DataFrame) -> DataFrame:
    """files (path, size_bytes, content) of known languages, with language and line counts instead of content.

    Each step is a projection of its own: what the next one uses several times is computed once.
    """
    known = files.select("path", "size_bytes", "content", paths.language(F.col("path")).alias("language")).filter("language is not null")
    blocks, row = paths.has_blocks(F.col("language")), ["path", "language", "size_bytes"]
    texts = known.select(*row, F.when(blocks, F.col("content")).alias("scan"), F.when(~blocks, L.unix(L.as_latin(F.col("content")))).alias("text"))
    native = _native(F.col("text"), F.col("language"))
    counted = texts.select(*row, _scanned("scan", "language").alias("scanned"), *[c.alias(name) for name, c in native.items()])
    plain = {"code_lines": F.col("total") - F.col("comment") - F.col("empty"), "comment_lines": F.col("comment"), "empty_lines": F.col("empty")}
    return counted.select(*row, *[F.coalesce(F.col(f"scanned.{c}"), plain[c]).cast("bigint").alias(c) for c in COUNTS])


def by_language(counted: DataFrame) -> DataFrame:
    """Sums by language, most code first; languages whose files are all empty are left out."""
    sums = counted.groupBy("language").agg(*[F.sum(c).alias(c) for c in SUMS])
    some = F.greatest(*SUMS) > 0
    return sums.filter(some).orderBy(*[F.desc(c) for c in COUNTS], "language")


def totals(counted: DataFrame) -> DataFrame:
    """One row: the sums, files_scanned and languages_detected."""
    by = counted.groupBy("language").agg(*[F.sum(c).alias(c) for c in SUMS], F.count("*").alias("files"))
    some = (F.greatest(*SUMS) > 0).cast("bigint")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return by.agg(*[zero(F.sum(c)).alias(c) for c in SUMS], zero(F.sum("files")).alias("files_scanned"), zero(F.sum(some)).alias("languages_detected"))


def rollup(counted: DataFrame) -> DataFrame:
    """Sums by language and, with a null language, over all."""
    return counted.rollup("language").agg(*[F.sum(c).alias(c) for c in SUMS], F.count("*").alias("files"))
