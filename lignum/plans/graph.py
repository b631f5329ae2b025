"""Dependency graph reports: the whole graph, what a focus imports, or what depends on a file."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import tree


@dataclass
class GraphTables:
    """nodes (path, language, imports_count, imported_by_count) and edges, unordered."""

    nodes: DataFrame
    edges: DataFrame
    depth: int | None
    query: str | None


@dataclass
class GraphReport:
    base_path: str
    focus_paths: list[str]
    depth: int | None
    query: dict[str, str] | None
    nodes: list[dict]
    edges: list[dict]
    metrics: dict[str, Any]

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def target(base: str | Path, path: str) -> str:
    """A queried path from the base folder; ValueError where it leads out of it."""
    p = path.replace("\\", "/")
    if posixpath.isabs(p):
        root = Path(base).resolve().as_posix()
        p = posixpath.relpath(p, root)
    p = posixpath.normpath(p)
    if p == ".." or p.startswith("../"):
        raise ValueError(f"the path lies outside of {base}: {path}")
    return p


def select(files: DataFrame, focus: Sequence[str] = (), depth: int | None = None, depends_on: str | None = None, extended: bool = False) -> GraphTables:
    """The graph of a table of files, or the part that focus and query select."""
    read = graph.analysed(files, extended)
    edges = graph.written(graph.edges_of(files, extended), "edges")
    nodes = graph.written(graph.nodes_of(read, edges), "nodes")
    if not focus and depends_on is None:
        return GraphTables(graph.degrees(nodes, edges), edges, None, None)
    chosen = []
    if focus:
        chosen.append(graph.reachable(nodes.filter(graph.under(F.col("path"), focus)), edges, depth))
    if depends_on is not None:
        root = nodes.filter(F.col("path") == depends_on)
        if not root.take(1):
            raise ValueError(f"no file of the graph has the path {depends_on}")
        chosen.append(graph.reachable(root, edges, depth, reverse=True))
    paths = chosen[0].select("path")
    for more in chosen[1:]:
        paths = paths.union(more.select("path"))
    paths = graph.written(paths.distinct(), "selected")
    kept = graph.written(graph.subset(edges, paths), "kept")
    return GraphTables(graph.degrees(nodes.join(paths, "path", "left_semi"), kept), kept, depth, depends_on)


def report(tables: GraphTables, base_path: str = ".", focus: Sequence[str] = ()) -> GraphReport:
    """Collects a graph, in order, to be rendered; for one too large for that use the tables."""
    nodes = graph.written(tables.nodes, "degrees")
    counts = graph.edge_counts(tables.edges).first()
    tops = {k: [{"file_path": r.path, "count": r["count"]} for r in graph.top(nodes, c).collect()] for k, c in (("most_importing", "imports_count"), ("most_imported", "imported_by_count"))}
    rings = graph.cycles(tables.edges)
    shown = [{"file_path": r.path, "language": r.language, "imports_count": r.imports_count, "imported_by_count": r.imported_by_count} for r in nodes.orderBy("path").collect()]
    edges = [{"from": r["from"], "to": r["to"], "import_path": r["import_path"], "resolved": r["resolved"]} for r in tables.edges.orderBy("from", "ord").collect()]
    metrics = {"total_files": len(shown), "total_internal_edges": counts["internal_edges"], "total_external_edges": counts["external_edges"], "circular_dependencies": len(rings), **tops, "cycles": rings}
    query = None if tables.query is None else {"depends_on": tables.query}
    return GraphReport(base_path, list(focus), tables.depth, query, shown, edges, metrics)


def build(spark: SparkSession, base: str | Path, ignore: Sequence[str] = (), focus: Sequence[str] = (), depth: int | None = None, depends_on: str | None = None, extended: bool = False, shown: str | None = None) -> GraphReport:
    root = Path(base).resolve()
    inside = [Path(f).resolve().relative_to(root).as_posix() if Path(f).is_absolute() else f.replace("\\", "/") for f in map(str, focus)]
    asked = None if depends_on is None else target(base, depends_on)
    return report(select(tree.files(spark, base, ignore), inside, depth, asked, extended), shown or str(base), inside)
