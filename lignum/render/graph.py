"""Dependency graphs as JSON, Markdown with a diagram, XML or DOT."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from ..plans.graph import GraphReport
from .context import grid

DIAGRAM_EDGES = 50


def to_json(r: GraphReport) -> str:
    """A report that JSON can't hold gives an object with its error."""
    out = r.as_dict()
    try:
        return json.dumps({k: v for k, v in out.items() if not (k in ("depth", "query") and v is None)}, indent=2, ensure_ascii=False)
    except (TypeError, ValueError) as e:
        return json.dumps({"error": f"no JSON for this report: {e}"})


def _inside(r: GraphReport) -> list[dict]:
    return [e for e in r.edges if e["resolved"]]


def markdown(r: GraphReport) -> str:
    m = r.metrics
    out = ["# Dependency Graph Report", "", f"**Base path:** `{r.base_path}`", ""]
    if r.focus_paths:
        out += ["**Focus paths:** " + ", ".join(f"`{p}`" for p in r.focus_paths), ""]
    if r.depth is not None:
        out += [f"**Depth:** `{r.depth}`", ""]
    if r.query:
        out += [f"**Query:** `what depends on {r.query['depends_on']}`", ""]
    facts = {"Files analyzed": "total_files", "Internal edges": "total_internal_edges", "External edges": "total_external_edges", "Circular dependencies": "circular_dependencies"}
    out += ["## Summary", "", *grid(["Metric", "Value"], [[k, m[v]] for k, v in facts.items()], 0), ""]
    for title, key, column in (("Most Imported Files", "most_imported", "Imported by"), ("Most Importing Files", "most_importing", "Imports")):
        if m[key]:
            out += [f"## {title}", "", *grid(["File", column], [[f"`{x['file_path']}`", x["count"]] for x in m[key]], 0), ""]
    if m["cycles"]:
        out += ["## Circular Dependencies", "", *[f"{k}. " + " → ".join(f"`{p}`" for p in ring) for k, ring in enumerate(m["cycles"], 1)], ""]
    if edges := _inside(r):
        ids = {n["file_path"]: f"n{k}" for k, n in enumerate(r.nodes)}
        out += ["## Dependency Diagram", "", "```mermaid", "graph LR", *[f'    {k}["{p.rpartition("/")[2]}"]' for p, k in ids.items()]]
        out += [f"    {ids[e['from']]} --> {ids[e['to']]}" for e in edges[:DIAGRAM_EDGES] if e["from"] in ids and e["to"] in ids]
        if len(edges) > DIAGRAM_EDGES:
            out.append(f"    %% ... and {len(edges) - DIAGRAM_EDGES} more edges")
        out.append("```")
    return "\n".join(out) + "\n"


def _tag(name: str, attributes: dict[str, object], close: str = "/>") -> str:
    return f"<{name}" + "".join(f" {k}={quoteattr(str(v), {chr(39): '&apos;', chr(34): '&quot;'})}" for k, v in attributes.items()) + close


def xml(r: GraphReport) -> str:
    m = r.metrics
    text = lambda name, value: f"<{name}>{escape(str(value), {chr(34): '&quot;', chr(39): '&apos;'})}</{name}>"
    out = ['<?xml version="1.0" encoding="UTF-8"?>', "<dependency-graph>", "  " + text("base-path", r.base_path)]
    chosen = ["    <focus-paths>", *["      " + text("focus-path", p) for p in r.focus_paths], "    </focus-paths>"] if r.focus_paths else []
    if r.depth is not None:
        chosen.append("    " + text("depth", r.depth))
    if r.query:
        chosen.append("    " + text("query", f"depends_on:{r.query['depends_on']}"))
    if chosen:
        out += ["  <selection>", *chosen, "  </selection>"]
    out += ["  <metrics>", *["    " + text(name, m[k]) for name, k in (("total-files", "total_files"), ("internal-edges", "total_internal_edges"), ("external-edges", "total_external_edges"), ("circular-dependencies", "circular_dependencies"))]]
    for name, key in (("most-imported", "most_imported"), ("most-importing", "most_importing")):
        if m[key]:
            out += [f"    <{name}>", *["      " + _tag("file", {"path": x["file_path"], "count": x["count"]}) for x in m[key]], f"    </{name}>"]
    if m["cycles"]:
        out += ["    <cycles>", *[line for ring in m["cycles"] for line in ("      <cycle>", *["        " + text("node", p) for p in ring], "      </cycle>")], "    </cycles>"]
    out += ["  </metrics>", "  <nodes>"]
    out += ["    " + _tag("node", {"path": n["file_path"], "language": n["language"] or "unknown", "imports": n["imports_count"], "imported-by": n["imported_by_count"]}) for n in r.nodes]
    out += ["  </nodes>", "  <edges>"]
    out += ["    " + _tag("edge", {"from": e["from"], "to": e["to"] or "(unresolved)", "import": e["import_path"], "resolved": str(e["resolved"]).lower()}) for e in r.edges]
    return "\n".join([*out, "  </edges>", "</dependency-graph>"]) + "\n"


def _dot_text(x: str) -> str:
    return x.replace("\\", "\\\\").replace('"', '\\"')


def dot(r: GraphReport) -> str:
    ids = str.maketrans("/.-", "___")
    out = ["digraph dependencies {", "  rankdir=LR;", "  node [shape=box];"]
    out += [f'  "{_dot_text(n["file_path"].translate(ids))}" [label="{_dot_text(n["file_path"])}"];' for n in r.nodes]
    out += [f'  "{_dot_text(e["from"].translate(ids))}" -> "{_dot_text(e["to"].translate(ids))}";' for e in _inside(r)]
    return "\n".join([*out, "}"]) + "\n"


FORMATS = {"json": to_json, "markdown": markdown, "xml": xml, "dot": dot}
