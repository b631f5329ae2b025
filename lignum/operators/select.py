"""Which files belong in a context pack, and in what order."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lines as L
from ..functions import paths

#: class -> (rank, group)
CLASSES = {
    "focused-file": (0, "focus"), "diff-file": (1, "changes"), "focused-descendant": (2, "focus"), "manifest": (3, "project-metadata"),
    "workflow": (4, "workflows"), "entrypoint": (5, "entrypoints"), "adjacent-test": (6, "testing"), "general": (7, "general"),
}
#: group -> label, in the order in which groups are shown
GROUPS = {"focus": "Focus", "changes": "Changes", "entrypoints": "Entrypoints", "testing": "Testing", "project-metadata": "Project Metadata", "workflows": "Workflows", "general": "General"}
LOW_SIGNAL = sorted("target node_modules fuzz/target fuzz/corpus fuzz/artifacts dist build benchmarks/reports benchmarks/generated_corpus __pycache__ .venv .git".split())
_MANIFESTS = sorted("pyproject.toml poetry.lock package.json composer.json Cargo.toml Cargo.lock .gitignore .gitattributes .editorconfig".split())
MAX_BYTES, SNIFF_BYTES, LINE_BYTES = 1 << 20, 1 << 15, 2000


class Focus(NamedTuple):
    """A focused path inside the tree; a folder's '' is the tree itself."""

    path: str
    is_dir: bool


def _any(tests: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def is_low_signal(path: Column) -> Column:
    return _any([path.startswith(f"{p}/") for p in LOW_SIGNAL])


def is_workflow(path: Column) -> Column:
    return path.startswith(".github/workflows/")


def is_manifest(path: Column) -> Column:
    name = paths.base_name(path)
    return name.isin(_MANIFESTS) | _any([F.upper(name).startswith(x) for x in ("README", "LICENSE", "CHANGELOG")])


def is_entrypoint(path: Column) -> Column:
    name = paths.base_name(path)
    return (name == "mod.rs") | name.startswith("main.") | name.startswith("lib.")


def is_test(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ("tests", "examples", "benches"))))


def focus_class(path: Column, focuses: Sequence[Focus]) -> Column:
    """The class that the first matching focus gives, in order of path; null where none does."""
    found = F.lit(None).cast("string")
    for f in reversed(sorted(set(focuses))):
        inside = (F.lit(True) if f.path in ("", ".") else (path == f.path) | path.startswith(f.path + "/")) if f.is_dir else path == f.path
        found = F.when(inside, F.lit("focused-descendant" if f.is_dir else "focused-file")).otherwise(found)
    return found


def selection_class(path: Column, focuses: Sequence[Focus], changed: Column) -> Column:
    focused = focus_class(path, focuses)
    out = F.when(focused.isNotNull(), focused).when(changed, "diff-file")
    for test, name in ((is_workflow, "workflow"), (is_manifest, "manifest"), (is_entrypoint, "entrypoint"), (is_test, "adjacent-test")):
        out = out.when(test(path), name)
    return out.otherwise("general")


def _of_class(value: Column, which: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for name, row in CLASSES.items() for x in (name, row[which])]), value)


def rank_of(value: Column) -> Column:
    return _of_class(value, 0)


def group_of(value: Column) -> Column:
    return _of_class(value, 1)


def with_changes(files: DataFrame, changed: DataFrame | None) -> DataFrame:
    """files with `changed`, by a semi-join's flag; changed has a path column, each path once or more."""
    if changed is None:
        return files.withColumn("changed", F.lit(False))
    marks = changed.select(F.col("path").alias("changed_path")).distinct()
    return files.join(marks, files.path == marks.changed_path, "left").withColumn("changed", F.col("changed_path").isNotNull()).drop("changed_path")


def is_considered(focuses: Sequence[Focus], changed: Column) -> Column:
    path = F.col("path")
    return focus_class(path, focuses).isNotNull() | changed | ~is_low_signal(path)


def can_show(changed: Column) -> Column:
    """Whether a file's path and size allow it in a pack."""
    path = F.col("path")
    return (changed | paths.language(path).isNotNull() | is_manifest(path) | is_workflow(path)) & F.col("size_bytes").between(1, MAX_BYTES)


def considered(files: DataFrame, focuses: Sequence[Focus] = (), changed: DataFrame | None = None) -> DataFrame:
    """files (path, size_bytes, ...) without low-signal ones, with language, changed and class."""
    marked = with_changes(files, changed)
    path = F.col("path")
    kept = marked.filter(is_considered(focuses, F.col("changed")))
    return kept.withColumns({"language": paths.language(path), "class": selection_class(path, focuses, F.col("changed"))})


def is_text(content: Column) -> Column:
    """Whether the begin of a file is neither binary nor minified."""
    sniff = L.as_latin(F.substring(content, 1, SNIFF_BYTES))
    return (F.locate("\0", sniff) == 0) & ~L.has_long_line(sniff, LINE_BYTES)


def candidates(considered_: DataFrame) -> DataFrame:
    """Those that a pack can show; uses content or what `is_text` said of it, if the table has it, to leave out binary and minified files."""
    kept = considered_.filter(can_show(F.col("changed")))
    if "content" in considered_.columns:
        return kept.filter(is_text(F.col("content")))
    return kept.filter("is_text") if "is_text" in considered_.columns else kept


def order() -> list[Column]:
    """The rank of candidates: class, then the smaller, then the path."""
    return [rank_of(F.col("class")), F.col("size_bytes"), F.col("path")]


def size_range() -> Column:
    """The range of sizes of a file, in order: its octave and the next eight bits."""
    octave = F.length(F.bin("size_bytes")).cast("int")
    return octave * 256 + F.expr("cast(shiftright(size_bytes, greatest(0, length(bin(size_bytes)) - 9)) & 255 as int)")


def ranked(candidates_: DataFrame) -> DataFrame:
    """Candidates with their 1-based rank inside each class: counts of ranges of sizes, then places inside these, so that no task sees a class."""
    placed = candidates_.withColumn("range", size_range())
    counts = placed.groupBy("class", "range").agg(F.count("*").alias("n"))
    bases = counts.select("class", "range", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("class", "range").orderBy("size_bytes", "path"))
    return placed.join(F.broadcast(bases), ["class", "range"]).withColumn("class_rank", (F.col("base") + inside).cast("bigint")).drop("base", "range")  # at most 8 classes of 64 * 256 ranges


def dominant_languages(considered_: DataFrame) -> DataFrame:
    sums = considered_.filter("language is not null").groupBy("language").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))
    return sums.orderBy(F.desc("size_bytes"), F.desc("files"), "language")
