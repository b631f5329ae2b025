"""The language registry: comment styles, and each language with its style, extensions and exact file names.

Patterns that start with a dot are extensions; others are whole file names.
Both are case-sensitive, and a whole name goes before an extension.
"""

from __future__ import annotations

from typing import NamedTuple


class Style(NamedTuple):
    single: str | None
    start: str | None
    end: str | None


class Language(NamedTuple):
    style: str
    extensions: tuple[str, ...]
    names: tuple[str, ...]


STYLES: dict[str, Style] = {
    "ada": Style("--", "/*", "*/"),
    "asm": Style(";", None, None),
    "autohotkey": Style(";", "/*", "*/"),
    "basic": Style("'", None, None),
    "batchfile": Style("REM", None, None),
    "c": Style("//", "/*", "*/"),
    "clojure": Style(";", None, None),
    "cobol": Style("*>", None, None),
    "coffee_script": Style("###", "/*", "*/"),
    "eiffel": Style("--", None, None),
    "elixir": Style("#", "\"\"\"", "\"\"\""),
    "erlang": Style("%%", None, None),
    "fortran": Style("!", None, None),
    "fsharp": Style("//", "(*", "*)"),
    "godot": Style("#", None, None),
    "haskell": Style("--", "{-", "-}"),
    "html": Style(None, "<!--", "-->"),
    "julia": Style("#", "#=", "=#"),
    "lisp": Style(";", "#|", "|#"),
    "lua": Style("--", "--[[", "]]"),
    "matlab": Style("%", "%{", "}%"),
    "meson": Style("#", "/*", "*/"),
    "nim": Style("#", "#[", "]#"),
    "no_comment": Style(None, None, None),
    "ocaml": Style(None, "(*", "*)"),
    "pascal": Style("//", "{", "}"),
    "perl": Style("#", "=", "=cut"),
    "python": Style("#", "\"\"\"", "\"\"\""),
    "ruby": Style("#", "=begin", "=end"),
    "shell": Style("#", None, None),
    "smalltalk": Style("\"", None, None),
    "sql": Style("--", "/*", "*/"),
    "tex": Style("%", None, None),
    "vhdl": Style("--", None, None),
    "vim": Style("\"", None, None),
}

_PATTERNS = {
    "Action Script": ("c", ".as"),
    "Ada": ("ada", ".ada .adb"),
    "Apache Config": ("shell", ".htaccess"),
    "APL": ("no_comment", ".apl"),
    "Apple Script": ("c", ".applescript"),
    "ASP.NET": ("html", ".asp"),
    "ASPX": ("html", ".aspx"),
    "Assembly": ("asm", ".asm"),
    "AutoHotkey Script": ("autohotkey", ".ahk"),
    "BASIC": ("basic", ".bas"),
    "Batch File": ("batchfile", ".bat .cmd"),
    "Brainfuck": ("no_comment", ".bf"),
    "C": ("c", ".c"),
    "C Header File": ("c", ".h"),
    "C#": ("c", ".cs"),
    "C++": ("c", ".c++ .cc .cpp .cxx"),
    "C++ Header File": ("c", ".h++ .hh .hpp"),
    "Carbon": ("c", ".carbon"),
    "Cg": ("c", ".cg"),
    "Chef": ("no_comment", ".chef"),
    "Clojure": ("clojure", ".clj"),
    "CMake": ("shell", ".cmake"),
    "COBOL": ("cobol", ".cbl"),
    "Coffee Script": ("coffee_script", ".coffee"),
    "Crytal": ("shell", ".cr"),
    "CSS": ("c", ".css"),
    "CUDA": ("c", ".cu"),
    "Cython": ("python", ".pxd .pxi .pyx"),
    "D": ("c", ".d"),
    "Dart": ("c", ".dart"),
    "Dockerfile": ("shell", "Dockerfile"),
    "Dylan": ("c", ".dylan"),
    "Eiffel": ("eiffel", ".e"),
    "Elixir": ("elixir", ".ex .exs"),
    "Emacs Lisp": ("lisp", ".el .elc .eln"),
    "Erlang": ("erlang", ".erl"),
    "F#": ("fsharp", ".fs"),
    "Fantom": ("c", ".fan"),
    "Fish Script": ("shell", ".fish"),
    "Fortran": ("fortran", ".f .f95"),
    "GameMarker Studio": ("c", ".gml"),
    "GLSL": ("c", ".glsl"),
    "Godot Script": ("godot", ".gd"),
    "Golang": ("c", ".go"),
    "GraphQL": ("shell", ".gql .graphql"),
    "Groovy": ("c", ".groovy"),
    "Haskell": ("haskell", ".hs"),
    "HLSL": ("c", ".hlsl"),
    "HTML": ("html", ".htm .html"),
    "Java": ("c", ".java"),
    "JavaScript": ("c", ".js .mjs"),
    "Jinja2 Template": ("no_comment", ".j2"),
    "JSON": ("no_comment", ".json"),
    "Julia": ("julia", ".jl"),
    "Jupyter Notebook": ("no_comment", ".ipynb"),
    "KornShell": ("shell", ".ksh"),
    "Kotlin": ("c", ".kt"),
    "Kotlin Build Script": ("c", ".kts"),
    "Lisp": ("lisp", ".lisp .lsp"),
    "Lua": ("lua", ".lua"),
    "M4": ("shell", ".m4"),
    "Makefile": ("shell", "Makefile"),
    "Markdown": ("no_comment", ".md"),
    "MATLAB": ("matlab", ".mlx"),
    "Meson": ("meson", ".meson"),
    "Nim": ("nim", ".nim"),
    "Nix": ("shell", ".nix"),
    "Objective-C": ("c", ".m"),
    "Objective-C++": ("c", ".mm"),
    "OCaml": ("ocaml", ".ml"),
    "OpenCL": ("c", ".cl"),
    "Pascal": ("pascal", ".pas"),
    "Perl": ("perl", ".pl"),
    "PHP": ("c", ".php"),
    "PowerShell": ("shell", ".ps1"),
    "Python": ("python", ".py"),
    "QML": ("c", ".qml"),
    "R": ("shell", ".r"),
    "React JavaScript": ("c", ".jsx"),
    "React TypeScript": ("c", ".tsx"),
    "Ruby": ("ruby", ".rb"),
    "Rust": ("c", ".rs"),
    "Scala": ("c", ".sc .scala"),
    "Scheme": ("lisp", ".scm"),
    "SCSS": ("c", ".scss"),
    "Shell Script": ("shell", ".sh"),
    "Smalltalk": ("smalltalk", ".st"),
    "SQL": ("sql", ".sql"),
    "Swift": ("c", ".swift"),
    "TCL": ("shell", ".tcl"),
    "Tex": ("tex", ".tex"),
    "TOML": ("shell", ".toml"),
    "TypeScript": ("c", ".ts"),
    "Unreal Script": ("c", ".uc"),
    "V Lang": ("c", ".v .vsh"),
    "Verilog": ("c", ".verilog .vlg"),
    "VHDL": ("vhdl", ".vhd"),
    "Vim Script": ("vim", ".vim .vimrc"),
    "Visual Basic": ("basic", ".vb"),
    "XML": ("html", ".xml"),
    "YAML": ("shell", ".yaml .yml"),
    "Zig": ("c", ".zig"),
    "Zsh": ("shell", ".zsh"),
}


def _language(style: str, patterns: str) -> Language:
    each = patterns.split()
    return Language(style, tuple(p[1:] for p in each if p[0] == "."), tuple(p for p in each if p[0] != "."))


LANGUAGES: dict[str, Language] = {name: _language(*row) for name, row in _PATTERNS.items()}


def validate(languages: dict[str, Language] = LANGUAGES, styles: dict[str, Style] = STYLES) -> None:
    """ValueError for an unknown style, an empty or twice-used pattern, or half a block style."""
    seen: dict[str, str] = {}
    for name, style in styles.items():
        if (style.start is None) != (style.end is None):
            raise ValueError(f"style {name} needs both block tokens or neither")
        if "" in style:
            raise ValueError(f"style {name} has an empty token")
    for name, language in languages.items():
        if not name.strip():
            raise ValueError("a language has no name")
        if language.style not in styles:
            raise ValueError(f"language {name} has the unknown style {language.style}")
        if not language.extensions and not language.names:
            raise ValueError(f"language {name} has no pattern")
        for pattern in [f".{e}" for e in language.extensions] + list(language.names):
            if pattern in ("", ".") or "/" in pattern or "." in pattern[1:] and pattern[0] == ".":
                raise ValueError(f"language {name} has the bad pattern {pattern!r}")
            if pattern in seen:
                raise ValueError(f"{pattern} belongs to {seen[pattern]} and {name}")
            seen[pattern] = name


def by_extension() -> dict[str, str]:
    return {e: name for name, language in sorted(LANGUAGES.items()) for e in language.extensions}


def by_name() -> dict[str, str]:
    return {n: name for name, language in sorted(LANGUAGES.items()) for n in language.names}
