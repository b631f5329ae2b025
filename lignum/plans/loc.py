"""Lines of code of a folder or of any table of files."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators import loc
from ..sources import tree


@dataclass
class LocReport:
    base_path: str
    by_language: list[dict]
    totals: dict
    files_scanned: int
    languages_detected: int
    elapsed: float


def report(files: DataFrame, base_path: str = ".") -> LocReport:
    """Counts of a table of files (path, size_bytes, content); one pass over it, the rest from a row a language."""
    began = time.perf_counter()
    counted = loc.with_counts(files)
    rows = [r.asDict() for r in loc.rollup(counted).collect()]  # a row for each language at most
    whole = next((r for r in rows if r["language"] is None), None)
    langs = [r for r in rows if r["language"] is not None and any(r[c] for c in loc.SUMS)]
    langs.sort(key=lambda r: (*[-r[c] for c in loc.COUNTS], r["language"]))
    totals = {c: (whole[c] or 0) if whole else 0 for c in loc.SUMS}
    by = [{k: r[k] for k in ("language", *loc.SUMS)} for r in langs]
    return LocReport(base_path, by, totals, whole["files"] if whole else 0, len(by), time.perf_counter() - began)


def analyze(spark: SparkSession, base: str | Path, ignore: Sequence[str] = (), shown: str | None = None) -> LocReport:
    return report(tree.files(spark, base, ignore), shown or str(base))
