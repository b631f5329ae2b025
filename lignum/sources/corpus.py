"""A made-up source tree of any size, as a table of files: modules of the same templates, with bodies repeated to size."""

from __future__ import annotations

import shutil
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Dataset(NamedTuple):
    modules: int
    files: int
    repeat: int
    target_bytes: int | None = None


DATASETS = {"small": Dataset(3, 3, 16), "medium": Dataset(8, 5, 64), "large": Dataset(16, 8, 160), "extra-large": Dataset(16, 8, 1, 2 << 30)}
DEFAULT = ("small", "medium", "large")
#: extension -> (head, body, tail); the body is what repeats
TEMPLATES = {
    "rs": ("//! Unit.\n\n", "/* step */\npub fn run() -> u32 {\n    // one\n    1\n}\n\n", ""),
    "py": ("# Unit.\n\n", '"""Step."""\ndef run():\n    return 1  # one\n\n', ""),
    "ts": ("// Unit.\n\n", "/* step */\nexport const run = (): number => 1;\n\n", ""),
    "html": ("<!doctype html>\n<body>\n", "<!-- step -->\n<p>one</p>\n\n", "</body>\n"),
    "json": ('{"unit": [\n', '  {"step": 1},\n\n', "  null\n]}\n"),
    "toml": ("# Unit.\n", "[[step]]\n# one\none = 1\n\n", ""),
    "sh": ("#!/bin/sh\n", "# step\necho one\n\n", ""),
}
ROOT_FILES = {"Makefile": "# Tasks.\nall:\n\techo one\n", "Dockerfile": "# Image.\nFROM scratch\n"}


def chosen(names: list[str] | None) -> list[str]:
    """Names of datasets, each once; the default ones without any."""
    out = list(dict.fromkeys(names or DEFAULT))
    for n in out:
        if n not in DATASETS:
            raise ValueError(f"no dataset {n!r}; there are: {', '.join(DATASETS)}")
    return out


def repeats(d: Dataset) -> int:
    """How often bodies repeat: as given, or the fewest times that reach the target size."""
    if d.target_bytes is None:
        return d.repeat
    each = d.modules * d.files
    fixed = sum(map(len, ROOT_FILES.values())) + each * sum(len(a) + len(c) for a, _, c in TEMPLATES.values())
    return max(1, -(-(d.target_bytes - fixed) // (each * sum(len(b) for _, b, _ in TEMPLATES.values()))))


def files(spark: SparkSession, d: Dataset) -> DataFrame:
    """(path, size_bytes, content), made by the tasks that read them."""
    n = repeats(d)
    kinds = F.array(*[F.struct(F.lit(e).alias("ext"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for e, (a, b, c) in TEMPLATES.items()])
    units = spark.range(d.modules * d.files).select((F.col("id") / d.files).cast("int").alias("m"), (F.col("id") % d.files).alias("f"), F.explode(kinds).alias("k"))
    made = units.select(F.format_string("module_%03d/file_%03d.%s", "m", "f", "k.ext").alias("path"), F.concat("k.a", F.repeat("k.b", n), "k.c").alias("text"))
    roots = spark.createDataFrame(list(ROOT_FILES.items()), "path string, text string")
    return made.unionByName(roots).select("path", F.octet_length("text").cast("bigint").alias("size_bytes"), F.encode("text", "UTF-8").alias("content"))


def write(folder: str | Path, names: list[str] | None = None, clean: bool = False) -> list[Path]:
    """Write the trees of the datasets, a folder each, and return these."""
    top = Path(folder)
    if clean and top.exists():
        shutil.rmtree(top)
    out = []
    for name in chosen(names):
        d = DATASETS[name]
        n, base = repeats(d), top / name
        for k in range(d.modules * d.files):
            for ext, (a, b, c) in TEMPLATES.items():
                path = base / f"module_{k // d.files:03d}" / f"file_{k % d.files:03d}.{ext}"
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(a + b * n + c)
        for file, text in ROOT_FILES.items():
            (base / file).write_text(text)
        out.append(base)
    return out


def statistics(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Of each group of measurements: samples, lowest, mean, median, highest."""
    v = F.col(value)
    return samples.groupBy(by).agg(F.count(v).alias("samples"), F.min(v).alias("lowest"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.max(v).alias("highest"))
