"""A folder as a table of files.

The driver lists names and sizes, pruning ignored folders, so that contents
are read on the executors and only of rows that still need them: `content` is
a column that Catalyst drops or filters before it is read. The folder must be
one that all executors see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ignore import Ignore
from ..operators.select import Focus

PARTITION_BYTES, PARTITION_FILES = 64 << 20, 10_000
_LISTED = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("size_bytes", T.LongType(), False), T.StructField("absolute", T.StringType(), False)])


def listed(base: str | Path, ignore: Ignore | None = None) -> list[tuple[str, int, str]]:
    """(path, size, absolute path) of the regular files, in order of path; links aren't followed."""
    base = Path(base)
    if not base.exists():
        raise FileNotFoundError(f"no such folder: {base}")
    if not base.is_dir():
        raise NotADirectoryError(f"not a folder: {base}")
    out: list[tuple[str, int, str]] = []
    waiting = [("", str(base))]
    while waiting:
        inside, folder = waiting.pop()
        with os.scandir(folder) as entries:
            for e in entries:
                path = inside + e.name
                if ignore and ignore.matches(path):
                    continue
                if e.is_dir(follow_symlinks=False):
                    waiting.append((path + "/", e.path))
                elif e.is_file(follow_symlinks=False):
                    out.append((path, e.stat(follow_symlinks=False).st_size, os.path.abspath(e.path)))
    return sorted(out, key=lambda row: row[0].encode("utf-8", "surrogateescape"))


@F.arrow_udf(T.BinaryType())
def _read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for names in batches:
        yield pa.array([Path(n).read_bytes() for n in names.to_pylist()], pa.binary())


def files(spark: SparkSession, base: str | Path, ignore: Sequence[str] = ()) -> DataFrame:
    """(path, size_bytes, content) of a folder."""
    rows = listed(base, Ignore(ignore))
    parts = max(1, sum(n for _, n, _ in rows) // PARTITION_BYTES, len(rows) // PARTITION_FILES)
    table = spark.createDataFrame(rows, _LISTED).repartition(parts, "path") if rows else spark.createDataFrame([], _LISTED)
    return table.select("path", "size_bytes", _read("absolute").alias("content"))


def focuses(base: str | Path, paths: Sequence[str | Path]) -> list[Focus]:
    """Focused paths, given from the base or absolute; each must exist inside it."""
    root = Path(base).resolve()
    out = set()
    for p in paths:
        given = Path(p)
        full = (given if given.is_absolute() else root / given).resolve()
        if not full.exists():
            raise FileNotFoundError(f"no such path to focus on: {p}")
        if root != full and root not in full.parents:
            raise ValueError(f"a focus must lie inside {root}: {p}")
        out.add(Focus("" if full == root else full.relative_to(root).as_posix(), full.is_dir()))
    return sorted(out)
