"""Sources without their bodies: signatures, declarations and comments of the top level.

There is no parser here but a splitter of masked text into top-level items, by
brackets, or for Python by indentation. What an item is follows from its first
words, so flags of parse errors are approximate: brackets that don't match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import in_pieces
from .imports import SYNTAX, syntax_of
from .masking import blanked, places

__all__ = ["SYNTAX", "Compressed", "compress", "compress_all", "compressed", "compressed_all", "syntax_of"]
MODES = ("none", "signatures", "skeleton")
RESULT = T.StructType([T.StructField("content", T.StringType()), T.StructField("items", T.LongType()), T.StructField("had_parse_errors", T.BooleanType())])

_VIS = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_MODS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|strictfp|default|sealed|non-sealed|@\w+(?:\([^)]*\))?)\s+)*"
#: first words of items that lose their body, and of those kept whole
_ELIDE = {
    "rust": _VIS + r"(?:(?:const|async|unsafe|default|extern(?:\s+\"[^\"]*\"|\s{2,})?)\s+)*(?:fn|impl|trait)\b",
    "python": r"(?:async\s+def|def|class)\b",
    "typescript": r"(?:async\s+)?function\b|(?:abstract\s+)?class\b",
    "javascript": r"(?:async\s+)?function\b|class\b",
    "go": r"func\b",
    "java": _MODS + r"class\b",
    "c": r"template\b",
    "cpp": r"template\b",
}
_KEEP = {
    "rust": _VIS + r"(?:use|struct|enum|type|const|static|mod|extern\s+crate|macro_rules!)|#!?\[",
    "python": r"(?:import|from|global)\b",
    "typescript": r"(?:import|export|interface|type|enum|const\s+enum|let|const|var)\b",
    "javascript": r"(?:import|export|let|const|var)\b",
    "go": r"(?:import|package|type|const|var)\b",
    "java": r"(?:import|package)\b|" + _MODS + r"(?:interface|enum|@interface)\b",
    "c": r"#[ \t]*(?:include|define|ifdef|ifndef)\b|typedef\b|struct\b|enum\b|using\b",
    "cpp": r"#[ \t]*(?:include|define|ifdef|ifndef)\b|typedef\b|struct\b|enum\b|using\b|namespace\b",
}
_SKELETON = {"python": r"(?:async\s+for|if|for|while)\b", "typescript": r"(?:if|for)\b", "javascript": r"(?:if|for)\b"}
_OTHER_PYTHON = re.compile(r"(?:if|for|while|with|try|return|raise|del|pass|assert|match|async|break|continue|nonlocal|else|elif|except|finally|@)\b|@")
_BRACKETS = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}
#: places that may matter, so that the rest of a text is passed over by the matcher
_BRACKET, _COLON, _END, _END_OR_LINE = (re.compile(x) for x in (r"[(){}\[\]]", r"[(){}\[\]:]", r"[(){}\[\];]", r"[(){}\[\];\n]"))
_SPACE, _BLANKS, _BETWEEN = re.compile(r"\s*"), re.compile(r"[ \t]*"), re.compile(r"[\s;]*")
_GOES_ON, _DECLARATOR, _ELSE = re.compile(r"\s*(?:else|from|while|as)\b"), re.compile(r"\w+\s*[;,=\[]"), re.compile(r"(?:else|from)\b")


class Compressed(NamedTuple):
    content: str
    items: int
    had_parse_errors: bool


def _balanced(masked: str) -> bool:
    open_: list[str] = []
    for c in _BRACKET.findall(masked):
        if c in "([{":
            open_.append(c)
        elif not open_ or open_.pop() + c not in ("()", "[]", "{}"):
            return False
    return not open_


def _python_items(masked: str, places: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Statements that begin in the first column, with what is indented below them."""
    depth, begin = 0, None
    last = 0
    at = 0
    continued = False
    decorated = False
    for line in masked.splitlines(keepends=True):
        text = line.strip()
        if text and not depth and not continued and not line[0].isspace():
            joins = decorated or re.match(r"(?:else|elif|except|finally)\b", text)
            if begin is not None and not joins:
                yield begin, last
                begin = None
            if begin is None:
                begin = at
            decorated = text.startswith("@")
        elif begin is None and text:
            begin = at
        depth = max(0, depth + sum(_BRACKETS[c] for c in _BRACKET.findall(text)))
        continued = text.endswith("\\")
        if text:
            last = at + len(line.rstrip())
        at += len(line)
    if begin is not None:
        yield begin, last


def _brace_items(masked: str, syntax: str) -> Iterator[tuple[int, int]]:
    """Items that end at a semicolon or a closing brace of the top level; directives are lines, #ifdef to its #endif."""
    at, n = 0, len(masked)
    ends = _END_OR_LINE if syntax in ("go", "javascript", "typescript") else _END
    while at < n:
        at = _BETWEEN.match(masked, at).end()  # type: ignore[union-attr]
        if at >= n:
            break
        begin, depth, end = at, 0, n
        if masked[at] == "#" and syntax in ("c", "cpp"):
            nested = 0
            while True:
                stop = masked.find("\n", at)
                while stop > 0 and masked[stop - 1] == "\\":
                    stop = masked.find("\n", stop + 1)
                stop = n if stop < 0 else stop
                word = re.match(r"[ \t]*#[ \t]*(\w*)", masked[at:stop])
                nested += (word[1] in ("if", "ifdef", "ifndef")) - (word[1] == "endif") if word else 0
                at = stop + 1
                if nested <= 0 or at >= n:
                    break
            yield begin, min(n, at - 1)
            continue
        if masked[at] == "#" and syntax == "rust":
            for m in _BRACKET.finditer(masked, at):
                depth += _BRACKETS[m[0]]
                if m[0] == "]" and not depth:
                    end = m.end()
                    break
            yield begin, end
            at = end
            continue
        line, passed = begin, 0  # begin of the line; up to where line ends are alike
        for m in ends.finditer(masked, at):
            k, c = m.start(), m[0]
            depth += _BRACKETS.get(c, 0)
            if depth > 0 or k < passed:
                continue
            if c == ";":
                end = k + 1
                break
            if c == "}":
                rest = _BLANKS.match(masked, k + 1).end()  # type: ignore[union-attr]
                # a declarator, a list of names or an else goes on
                if masked[rest : rest + 1] in (";", ",", "=", ".", "(") or _GOES_ON.match(masked, rest) or (syntax in ("c", "cpp") and _DECLARATOR.match(masked, rest)):
                    continue
                end = k + 1
                break
            if c == "\n":
                before, after = masked[line:k].rstrip()[-1:], _SPACE.match(masked, k).end()  # type: ignore[union-attr]
                if not depth and before not in tuple("=,+-*/&|?:.<>(") and masked[after : after + 1] not in tuple(".?:=&|+*{") and not _ELSE.match(masked, after):
                    end = k
                    break
                line = passed = after  # with no more than white space between them, line ends have the same before and after
        yield begin, end
        at = max(end, begin + 1)


def _elided(source: str, masked: str, begin: int, end: int, syntax: str) -> str:
    """Up to the body, with a mark in its place."""
    text = masked[begin:end]
    if syntax == "python":
        depth = 0
        head = begin
        lines = re.match(r"(?:@[^\n]*\n\s*)*", text)
        for m in _COLON.finditer(text, lines.end() if lines else 0):
            k = m.start()
            depth += _BRACKETS.get(m[0], 0)
            if m[0] == ":" and not depth:
                if text[k + 1 :].strip() or source[begin + k + 1 : end].strip():
                    body = k + 1
                    return source[head : begin + body].rstrip() + " { … }"
                break
        return source[begin:end].rstrip()
    depth = 0
    for m in _BRACKET.finditer(text):
        if m[0] == "{" and not depth:
            return source[begin : begin + m.start()].rstrip() + " { … }"
        depth += _BRACKETS[m[0]]
    return source[begin:end].rstrip()


def _kind(text: str, syntax: str, mode: str) -> str | None:
    """'elide', 'keep' or None, by the first words of an item (masked)."""
    if syntax == "python":
        if text.startswith("@"):
            return None
        if re.match(_ELIDE[syntax], text):
            return "elide"
        if mode == "skeleton" and re.match(_SKELETON[syntax], text):
            return "elide"
        if re.match(_KEEP[syntax], text):
            return "keep"
        return None if _OTHER_PYTHON.match(text) else "keep"  # an expression or assignment
    # const and static start both functions and constants in Rust; the function wins where there is one
    if re.match(_ELIDE[syntax], text):
        return "elide"
    if re.match(_KEEP[syntax], text):
        function = syntax in ("c", "cpp") and text[:1] != "#" and re.match(r"(?:struct|enum)\b[^;{]*\([^;]*\)\s*\{", text)
        return "elide" if function else "keep"
    if mode == "skeleton" and re.match(_SKELETON.get(syntax, r"(?!)"), text):
        return "elide"
    if syntax in ("c", "cpp") and text[:1] != "#" and not re.match(r"(?:class|union|public|private)\b", text):
        if re.match(r"[^;{=]*\([^;{]*\)[^;{=]*\{", text):
            return "elide"
        if re.match(r"(?:\w|::)[\w:<>,\s*&\[\]]*[\s*&][\w:]+", text) and text.rstrip().endswith(";"):
            return "keep"
    return None


def compress(source: str, syntax: str, mode: str) -> Compressed:
    """The compressed source, how many items it has, and whether brackets don't match."""
    return compress_all(source, syntax, (mode,))[0]


def compress_all(source: str, syntax: str, modes: Sequence[str]) -> list[Compressed]:
    """`compress` for each mode, with the source read once."""
    for mode in modes:
        if mode not in MODES:
            raise ValueError(f"unknown compression {mode!r}; one of {', '.join(MODES)}")
    found = places(source, syntax)
    masked = blanked(source, found)
    broken = not _balanced(masked)
    if all(mode == "none" for mode in modes):
        return [Compressed(source, 0, broken) for _ in modes]
    # strings at the top level of Python are masked whole, so its items are found in the text that keeps them
    told = blanked(source, found, strings=False) if syntax == "python" else masked
    spans = list(_python_items(told, [])) if syntax == "python" else list(_brace_items(masked, syntax))
    notes: list[tuple[int, str]] = []
    inside = 0
    for a, b, comment in found:
        if not comment:
            continue
        while inside < len(spans) and spans[inside][1] <= a:
            inside += 1
        if (inside == len(spans) or a < spans[inside][0]) and (text := source[a:b].rstrip()):
            notes.append((a, text))
    results: list[Compressed] = []
    for mode in modes:
        if mode == "none":
            results.append(Compressed(source, 0, broken))
            continue
        out = list(notes)
        for begin, end in spans:
            kind = _kind(told[begin:end], syntax, mode)
            if kind == "keep":
                out.append((begin, source[begin:end].rstrip()))
            elif kind == "elide":
                out.append((begin, _elided(source, masked, begin, end, syntax)))
        out.sort()
        results.append(Compressed("\n\n".join(t for _, t in out), len(out), broken))
    return results


def compressed(content: Column, language: Column, mode: str, extended: bool = False) -> Column:
    """RESULT of each file; null where the language isn't one that can be compressed."""
    return compressed_all(content, language, (mode,), extended)[0]


def compressed_all(content: Column, language: Column, modes: Sequence[str], extended: bool = False) -> Column:
    """An array with the RESULT for each mode; null where the language isn't one that can be compressed.

    It counts as not deterministic, else filters on it would read each file a second time.
    """

    def of(source: bytes | None, name: str | None) -> list[dict] | None:
        syntax = syntax_of(name, extended)
        return None if source is None or syntax is None else [c._asdict() for c in compress_all(source.decode("utf-8", "replace"), syntax, modes)]

    @F.arrow_udf(T.ArrayType(RESULT))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from in_pieces(batches, of, pa.list_(pa.struct([("content", pa.string()), ("items", pa.int64()), ("had_parse_errors", pa.bool_())])))

    return run.asNondeterministic()(content, language)
