"""Imports of a source file, found on masked text, and the places where each may lead.

`candidates` lists paths in the order in which they are tried, so that
resolving is an equi-join with the known files and the smallest ordinal wins.
Go looks for a folder's name and Java for a path's end; their candidates carry
the kind of key that the join uses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import in_pieces
from .masking import mask

#: language -> syntax. The extended ones are off by default.
SYNTAX = {"Rust": "rust", "Python": "python", "TypeScript": "typescript", "JavaScript": "javascript", "Java": "java", "C": "c", "C++": "cpp"}
EXTENDED = {"Golang": "go", "C Header File": "c", "C++ Header File": "cpp", "React JavaScript": "javascript", "React TypeScript": "typescript"}
MAX_BYTES = 512 * 1024

IMPORTS = T.ArrayType(T.StructType([T.StructField("import_path", T.StringType()), T.StructField("line", T.LongType()), T.StructField("keys", T.ArrayType(T.StringType()))]))


class Import(NamedTuple):
    path: str
    line: int


def syntax_of(language: str | None, extended: bool = False) -> str | None:
    return SYNTAX.get(language or "") or (EXTENDED.get(language or "") if extended else None)


_USE = re.compile(r"(?<![\w#])(?:pub(?:\s*\([^)]*\))?\s+)?use\s[^;]*;")
_PY = re.compile(r"(?:^|;|:)[ \t]*((?:from|import)\b(?:\([^)]*\)|\\\n|[^\n;(])*(?:\([^)]*\)?)?)", re.M)
_JS = re.compile(r"(?<![\w.$])(import|export)\b")
_REQUIRE = re.compile(r"(?<![\w.$])require\([^)]*\)")
_GO = re.compile(r"^[ \t]*import\b([ \t]*\([^)]*\)?|[^\n]*)", re.M)
_GO_SPEC = re.compile(r'"([^"\n]+)"')
_JAVA = re.compile(r"(?<![\w.])import\s[^;]*;")
_INCLUDE = re.compile(r"^[ \t]*#[ \t]*include[ \t]*(\"[^\"\n]+\"|<[^>\n]+>)", re.M)


def _rust(text: str) -> list[str]:
    body = text.removeprefix("use ").rstrip(";").strip()
    head, brace, inside = body.partition("{")
    if not brace:
        return [body]
    each = [x.strip() for x in inside.lstrip("{").rstrip("}").split(",")]
    return [f"{head.rstrip(':')}::{x}" for x in each if x] or [body]


def _python(text: str) -> list[str]:
    text = text.strip()
    if text.startswith("from"):
        return [text[5:].strip().split(" import")[0].strip()]
    return [x.strip() for x in text.removeprefix("import ").split(",")]


_QUOTES = "'\";"


def _js(source: str, masked: str) -> Iterator[tuple[int, str]]:
    for m in _JS.finditer(masked):
        at = m.start()
        # a statement ends at a semicolon or line end outside brackets
        depth, end = 0, len(masked)
        for k in range(at, len(masked)):
            c = masked[k]
            depth += (c in "{([") - (c in "})]")
            if c == ";" and depth <= 0:
                end = k + 1
                break
            if c == "\n" and depth <= 0 and source[at:k].rstrip()[-1:] in "'\"})":
                tail = masked[k:].lstrip()
                if not tail.startswith("from"):
                    end = k
                    break
            if depth < 0:
                end = k
                break
        text = source[at:end]
        if m[1] == "import" and masked[at + 6 : at + 7] in "(.":
            continue  # an expression
        _, found, rest = text.partition("from ")
        if found:
            if path := rest.strip().strip(_QUOTES):
                yield at, path
        elif text.startswith("import ") and (path := text[7:].strip().strip(_QUOTES)) and " " not in path:
            yield at, path
    for m in _REQUIRE.finditer(mask(source, "javascript", strings=False)):
        if masked[m.start() : m.start() + 8] == "require(" and (path := m[0].removeprefix("require(").rstrip(")").strip("'\"")):
            yield m.start(), path


def extract(source: str, syntax: str) -> list[Import]:
    """The imports in order of place, at any depth of nesting."""
    found: list[tuple[int, str]] = []
    if syntax in ("c", "cpp"):
        bare = mask(source, syntax, strings=False)
        found = [(m.start(), m[1].strip('"') if m[1][0] == '"' else m[1]) for m in _INCLUDE.finditer(bare)]
        found = [(at + len(bare[at:]) - len(bare[at:].lstrip()), p) for at, p in found]
    else:
        masked = mask(source, syntax)
        if syntax == "rust":
            found = [(m.start(), p) for m in _USE.finditer(masked) for p in _rust(source[m.start() : m.end()])]
        elif syntax == "python":
            found = [(m.start(1), p) for m in _PY.finditer(masked) for p in _python(source[m.start(1) : m.end(1)])]
        elif syntax == "java":
            found = [(m.start(), re.sub(r"^(?:static )+", "", source[m.start() : m.end()].removeprefix("import ")).rstrip(";").strip()) for m in _JAVA.finditer(masked)]
        elif syntax == "go":
            bare = mask(source, syntax, strings=False)
            found = [(m.start(1) + s.start(), s[1]) for m in _GO.finditer(masked) for s in _GO_SPEC.finditer(bare[m.start(1) : m.end(1)])]
        else:
            found = sorted(_js(source, masked))
    return [Import(p, source.count("\n", 0, at) + 1) for at, p in found]


def _join(base: str, rest: str) -> str:
    return f"{base}/{rest}" if base and rest else base or rest


def simplify(base: str, relative: str) -> str:
    """A relative path seen from a folder; '..' at the top stays there."""
    parts = base.split("/") if base else []
    for x in relative.split("/"):
        if x == "..":
            del parts[-1:]
        elif x not in ("", "."):
            parts.append(x)
    return "/".join(parts)


def candidates(path: str, source_file: str, syntax: str) -> list[str]:
    """Join keys in order of preference: 'f:path', for Go 'g:folder', for Java 'j:tail'."""
    folder = source_file.rpartition("/")[0]
    tried: list[str] = []
    if syntax == "rust":
        kind, _, rest = path.partition("::")
        own = source_file.removesuffix("/mod.rs") if source_file.endswith("/mod.rs") else source_file.removesuffix(".rs")
        if kind not in ("super", "self", "crate") or "::" not in path:
            return []
        if kind == "crate":
            above = source_file.split("/")[:-1]
            base = "/".join(above[: len(above) - above[::-1].index("src")]) if "src" in above else ""
        else:
            base = own if kind == "self" else own.rpartition("/")[0]
        rest = rest.replace("::", "/")
        module = f"{base}/{rest}" if base else rest
        tried = [f"{module}.rs", f"{module}/mod.rs"]
        if "/" in module:
            tried.append(module.rpartition("/")[0] + ".rs")
    elif syntax == "python":
        name = path.lstrip(".")
        up, module = len(path) - len(name), name.replace(".", "/")
        if up:
            parts = folder.split("/") if folder else []
            near = _join("/".join(parts[: max(0, len(parts) - up + 1)]), module)
            tried += [f"{near}.py", f"{near}/__init__.py"]
        tried += [f"{module}.py", f"{module}/__init__.py"]
    elif syntax in ("javascript", "typescript"):
        if path.startswith("."):
            stem = simplify(folder, path)
            tried = [stem + end for end in ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")]
    elif syntax == "go":
        return ["g:" + path.rpartition("/")[2]]
    elif syntax == "java":
        parts = path.replace(".", "/").split("/")
        for k in range(len(parts)):
            tail = "/".join(parts[k:]) + ".java"
            tried += [tail, "j:" + tail]
        return [x if x.startswith("j:") else "f:" + x for x in tried]
    elif not path.startswith("<"):
        tried = [f"{folder}/{path}" if folder else path, path]
    return ["f:" + x for x in dict.fromkeys(tried)]


def imports_of(content: Column, path: Column, language: Column, extended: bool = False) -> Column:
    """IMPORTS of each file; null where the language has none to extract.

    It counts as not deterministic, else filters on it, such as those that
    `explode` brings with it, would read each file a second time.
    """

    def of(content: bytes | None, file: str, language: str | None) -> list[dict] | None:
        syntax = syntax_of(language, extended)
        if content is None or syntax is None:
            return None
        return [{"import_path": i.path, "line": i.line, "keys": candidates(i.path, file, syntax)} for i in extract(content.decode("utf-8", "replace"), syntax)]

    @F.arrow_udf(IMPORTS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from in_pieces(batches, of, pa.list_(pa.struct([("import_path", pa.string()), ("line", pa.int64()), ("keys", pa.list_(pa.string()))])))

    return run.asNondeterministic()(content, path, language)
