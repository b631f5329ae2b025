"""A lexer that blanks out what isn't code: strings and comments, by language.

`mask` keeps the length and the line breaks of the source, so a place in the
masked text is a place in the source.
"""

from __future__ import annotations

import re

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*(?:"|$|\Z)', r"'(?:\\.|[^'\\\n])*(?:'|$|\Z)"
_TEMPLATE = r"`(?:\\.|[^`\\])*(?:`|\Z)"
_PYTHON = r'[rRbBuUfF]{0,2}(?:"""(?:\\.|[^\\])*?(?:"""|\Z)|' + r"'''(?:\\.|[^\\])*?(?:'''|\Z))"
_RUST_RAW = r'b?r(#*)".*?(?:"\1|\Z)'
_CHAR = r"'(?:\\[^\n]{1,10}?|[^'\\\n])'"
_RAW = r"`[^`]*(?:`|\Z)"

_COMMENTS = {"python": [r"#[^\n]*"]}
_STRINGS = {
    "python": [_PYTHON, _DOUBLE, _SINGLE],
    "rust": [_RUST_RAW, _DOUBLE, _CHAR],
    "go": [_RAW, _DOUBLE, _CHAR],
    "java": [r'""".*?(?:"""|\Z)', _DOUBLE, _CHAR],
    "javascript": [_TEMPLATE, _DOUBLE, _SINGLE],
    "typescript": [_TEMPLATE, _DOUBLE, _SINGLE],
    "c": [_DOUBLE, _CHAR],
    "cpp": [r'R"([^(\s]*)\(.*?(?:\)\2"|\Z)', _DOUBLE, _CHAR],
}
_COMPILED: dict[str, re.Pattern[str]] = {}


def _of(syntax: str) -> re.Pattern[str]:
    if syntax not in _COMPILED:
        comments = "|".join(_COMMENTS.get(syntax, [_LINE, _BLOCK]))
        strings = _STRINGS[syntax]
        numbered = "|".join(strings).replace(r"\1", r"(?P=x)").replace(r"\2", r"(?P=x)").replace("(#*)", "(?P<x>#*)").replace(r"([^(\s]*)", r"(?P<x>[^(\s]*)")
        _COMPILED[syntax] = re.compile(f"(?P<comment>{comments})|{numbered}", re.S | re.M)
    return _COMPILED[syntax]


def mask(source: str, syntax: str, strings: bool = True) -> str:
    """The source with comments, and strings if asked for, as spaces."""
    return blanked(source, places(source, syntax), strings)


def places(source: str, syntax: str) -> list[tuple[int, int, bool]]:
    """Strings and comments: begin, end and whether it is a comment."""
    return [(*m.span(), m["comment"] is not None) for m in _of(syntax).finditer(source)]


def blanked(source: str, found: list[tuple[int, int, bool]], strings: bool = True) -> str:
    """`mask` of a source whose places are known."""
    out, at = [], 0
    for a, b, comment in found:
        if comment or strings:
            out += source[at:a], _blank(source[a:b])
            at = b
    out.append(source[at:])
    return "".join(out)


def _blank(text: str) -> str:
    return " " * len(text) if "\n" not in text else "\n".join(" " * len(x) for x in text.split("\n"))
