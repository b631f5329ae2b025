"""The three analyses as tools of a JSON-RPC server on standard input and output, a message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable
from typing import Any, TextIO

from pyspark.sql import SparkSession

from .functions.tokens import parse_budget
from .plans import context, graph, loc
from .render import context as render_context
from .render import graph as render_graph
from .render import loc as render_loc
from .sources import config, git
from .sources.tables import checkouts

PROTOCOL = "2024-11-05"
_TEXT, _TEXTS, _FLAG = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "boolean"}
_SOURCE = {"path": _TEXT, "url": _TEXT, "ref": _TEXT, "ignore": _TEXTS}
TOOLS: dict[str, tuple[str, dict[str, Any]]] = {
    "loc": ("Count code, comment and empty lines by language.", _SOURCE),
    "context": ("Build a pack of file excerpts that fits a token budget.", _SOURCE | {"focus": _TEXTS, "config": _TEXT, "no_config": _FLAG, "profile": _TEXT, "list_profiles": _FLAG, "diff": _TEXT, "budget": {"type": ["integer", "string"]}, "compress": _TEXT, "format": _TEXT}),
    "graph": ("Map the imports between files.", _SOURCE | {"focus": _TEXTS, "depth": {"type": "integer"}, "depends_on": _TEXT, "format": _TEXT}),
}


def _loc(spark: SparkSession, source: git.Source, a: dict[str, Any]) -> str:
    return render_loc.plain(loc.analyze(spark, source.path, a.get("ignore", []), source.shown))


def _context(spark: SparkSession, source: git.Source, a: dict[str, Any]) -> str:
    found = config.find(source.path, a.get("config"), a.get("no_config", False))
    if a.get("list_profiles"):
        return render_context.profiles_json(found and source.display(found.path), list(found.profiles) if found else [])
    budget = a.get("budget")
    given = config.Context(a.get("ignore", []), a.get("focus", []), a.get("diff"), None if budget is None else parse_budget(budget), a.get("compress"), a.get("format"))
    settings = config.merge(given, found, a.get("profile"))
    return render_context.FORMATS[settings.format or "json"](context.build(spark, source, settings))


def _graph(spark: SparkSession, source: git.Source, a: dict[str, Any]) -> str:
    form = a.get("format", "json")
    if form not in render_graph.FORMATS:
        raise ValueError(f"unknown format {form!r}; one of {', '.join(render_graph.FORMATS)}")
    made = graph.build(spark, source.path, a.get("ignore", []), a.get("focus", []), a.get("depth"), a.get("depends_on"), shown=source.shown)
    return render_graph.FORMATS[form](made)


_RUN: dict[str, Callable[[SparkSession, git.Source, dict[str, Any]], str]] = {"loc": _loc, "context": _context, "graph": _graph}


class _Refused(Exception):
    def __init__(self, code: int, text: str) -> None:
        super().__init__(text)
        self.code = code


def _call(spark: SparkSession, params: dict[str, Any]) -> dict[str, Any]:
    name, arguments = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        raise _Refused(-32602, f"no tool {name!r}")
    if more := sorted(set(arguments) - set(TOOLS[name][1])):
        raise _Refused(-32602, f"{name} has no argument {more[0]!r}")
    try:
        source = git.resolve(arguments.get("path"), arguments.get("url"), arguments.get("ref"), checkouts(spark))
        text, failed = _RUN[name](spark, source, arguments), False
    except (ValueError, OSError, git.GitError) as e:
        text, failed = f"error: {e}", True
    return {"content": [{"type": "text", "text": text}], "isError": failed}


def answer(spark: SparkSession, message: Any) -> dict[str, Any] | None:
    """The reply to one message; none to a notification."""
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
    if "id" not in message:
        return None
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message["method"], message.get("params") or {}
    try:
        if method == "initialize":
            result: dict[str, Any] = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lignum", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": text, "inputSchema": {"type": "object", "properties": p, "additionalProperties": False}} for n, (text, p) in TOOLS.items()]}
        elif method == "tools/call":
            result = _call(spark, params)
        elif method == "ping":
            result = {}
        else:
            raise _Refused(-32601, f"no method {method!r}")
    except _Refused as e:
        return reply | {"error": {"code": e.code, "message": str(e)}}
    return reply | {"result": result}


def serve(spark: SparkSession, lines: Iterable[str], out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(spark, json.loads(line))
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()


if __name__ == "__main__":
    serve(SparkSession.builder.appName("lignum").getOrCreate(), sys.stdin, sys.stdout)
