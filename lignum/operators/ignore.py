"""Ignore patterns: a pattern with *, ? or [ is a glob on the file name, any other a regular expression searched in the path."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def glob_regex(glob: str) -> str:
    """An anchored regular expression that Java and Python read alike; ValueError for a broken glob."""
    out, at, depth = [], 0, 0
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "*":
            out.append(".*")
            while glob[at : at + 1] == "*":
                at += 1
        elif c == "?":
            out.append(".")
        elif c == "[":
            negated = glob[at : at + 1] in ("!", "^") and bool(glob[at : at + 1])
            begin = at + negated
            end = glob.find("]", begin + 1)
            if end < 0:
                raise ValueError("unclosed [")
            out.append("[" + "^" * negated + re.sub(r"([\[\]\\^&])", r"\\\1", glob[begin:end]) + "]")
            at = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and at < len(glob):
            out.append(re.escape(glob[at]))
            at += 1
        else:
            out.append(re.escape(c))
    if depth:
        raise ValueError("unclosed {")
    return "(?s)\\A" + "".join(out) + "\\z"


class Ignore:
    """Compiled patterns. ValueError names the first that is broken."""

    def __init__(self, patterns: Sequence[str] = ()) -> None:
        self.globs: list[str] = []
        self.regexes: list[str] = []
        for p in patterns:
            try:
                expression = glob_regex(p) if is_glob(p) else p
                re.compile(expression.replace("\\z", "\\Z"))
            except (ValueError, re.error) as e:
                raise ValueError(f"bad {'glob' if is_glob(p) else 'regex'} to ignore, {p!r}: {e}") from e
            (self.globs if is_glob(p) else self.regexes).append(expression)

    def column(self, path: Column) -> Column:
        """Whether a path is ignored."""
        p = paths.normalized(path)
        tests = [p.rlike(x) for x in self.regexes] + [paths.base_name(p).rlike(x) for x in self.globs]
        return functools.reduce(lambda a, b: a | b, tests, F.lit(False))

    def matches(self, path: str) -> bool:
        """The same, in the lister on the driver, where it prunes whole folders."""
        p = path.replace("\\", "/") or "."
        name = p.rpartition("/")[2]
        return any(re.search(x.replace("\\z", "\\Z"), p) for x in self.regexes) or any(re.search(x.replace("\\z", "\\Z"), name) for x in self.globs)


def keep(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Files that no pattern matches, themselves or by a folder above them."""
    if not patterns:
        return files
    ignore = Ignore(patterns)
    parts = F.split(paths.normalized(F.col("path")), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.filter(~F.exists(prefixes, ignore.column))
