import pytest
from hypothesis import given
from hypothesis import strategies as st

from lignum.operators import compress, imports, masking


@pytest.mark.parametrize(
    ("syntax", "source", "want"),
    [
        ("rust", "use std::io;\nuse crate::core::graph;\n// use no::one;\npub use a::b;\nuse std::collections::{HashMap, BTreeMap};\nfn f() { use super::x::*; let s = \"use q::r;\"; }", [("std::io", 1), ("crate::core::graph", 2), ("pub use a::b", 4), ("std::collections::HashMap", 5), ("std::collections::BTreeMap", 5), ("super::x::*", 6)]),
        ("python", "import os\nimport sys, re as r\nfrom a.b import (\n  c,\n  d)\nfrom . import e\n'''\nimport no\n'''\ndef f():\n    from ..x import y\nimportant = 1\n# import no\nif 1: import z", [("os", 1), ("sys", 2), ("re as r", 2), ("a.b", 3), (".", 6), ("..x", 11), ("z", 14)]),
        ("typescript", "import { a } from './a';\nimport './side';\nexport { b } from \"../b\";\nexport const c = 1;\nimport type { T } from 't'\nconst r = require('./r');\n// import x from 'no'\nimport {\n  d,\n} from './d';\nconst p = import('./dyn');", [("./a", 1), ("./side", 2), ("../b", 3), ("t", 5), ("./r", 6), ("./d", 8)]),
        ("go", 'package main\nimport "fmt"\nimport (\n  "os"\n  al "x/y"\n  // "no"\n)\nvar s = `import "no"`', [("fmt", 2), ("os", 4), ("x/y", 5)]),
        ("java", "package p;\nimport java.util.List;\nimport static a.B.*;\n/* import no.No; */\nclass X { String s = \"import no.No;\"; }", [("java.util.List", 2), ("a.B.*", 3)]),
        ("c", '#include <stdio.h>\n#  include "util.h"\n// #include "no.h"\n/*\n#include "no.h"\n*/\n#define X 1\n', [("<stdio.h>", 1), ("util.h", 2)]),
    ],
)
def test_imports(syntax, source, want):
    assert [tuple(i) for i in imports.extract(source, syntax)] == want


def first(path, source_file, syntax, known):
    """The file that an import leads to, by trying its keys one by one."""
    for key in imports.candidates(path, source_file, syntax):
        kind, name = key[0], key[2:]
        found = {"f": [k for k in known if k == name], "g": [k for k in known if k.endswith(".go") and k.rpartition("/")[0].rpartition("/")[2] == name], "j": [k for k in known if k.endswith(".java") and (k == name or k.endswith("/" + name))]}[kind]
        if found:
            return min(found)
    return None


CASES = [
    ("crate::core::types", "src/main.rs", "rust", ["src/core/types.rs"], "src/core/types.rs"),
    ("crate::core::types", "crates/x/src/a/b.rs", "rust", ["crates/x/src/core/types/mod.rs"], "crates/x/src/core/types/mod.rs"),
    ("crate::core::types::Name", "src/lib.rs", "rust", ["src/core/types.rs"], "src/core/types.rs"),
    ("super::x", "src/a/b.rs", "rust", ["src/a/x.rs"], "src/a/x.rs"),
    ("self::x", "src/a/mod.rs", "rust", ["src/a/x.rs"], "src/a/x.rs"),
    ("std::io", "src/a.rs", "rust", ["std/io.rs"], None),
    ("..shared.util", "pkg/sub/module.py", "python", ["pkg/shared/util.py"], "pkg/shared/util.py"),
    (".", "pkg/a.py", "python", ["pkg/__init__.py"], "pkg/__init__.py"),
    (".gone", "pkg/a.py", "python", ["gone.py"], "gone.py"),
    ("a.b", "x.py", "python", ["a/b/__init__.py", "a/b.py"], "a/b.py"),
    ("os as o", "x.py", "python", ["os.py"], None),
    ("../lib", "src/features/item.ts", "typescript", ["src/lib/index.ts"], "src/lib/index.ts"),
    ("./x", "a.js", "javascript", ["x.jsx", "x.js"], "x.js"),
    ("react", "a.js", "javascript", ["react.js"], None),
    ("github.com/demo/pkg", "main.go", "go", ["internal/pkg/service.go", "internal/pkg/a.go"], "internal/pkg/a.go"),
    ("com.example.utils.Helper", "src/A.java", "java", ["src/com/example/utils/Helper.java"], "src/com/example/utils/Helper.java"),
    ("com.example.utils.Helper", "src/A.java", "java", ["utils/Helper.java", "z/Helper.java"], "utils/Helper.java"),
    ("java.util.List", "src/A.java", "java", ["MyList.java"], None),
    ("util.h", "src/main.c", "c", ["util.h"], "util.h"),
    ("util.h", "src/main.c", "c", ["util.h", "src/util.h"], "src/util.h"),
    ("<stdio.h>", "src/main.c", "c", ["<stdio.h>", "stdio.h"], None),
]


@pytest.mark.parametrize(("path", "source_file", "syntax", "known", "want"), CASES)
def test_resolution(path, source_file, syntax, known, want):
    assert first(path, source_file, syntax, known) == want


@pytest.mark.parametrize(
    ("syntax", "source", "signatures", "skeleton"),
    [
        ("python", '"""Doc."""\nimport os\n\nX = 1\n\n@deco\ndef g(): pass\n\ndef f(a: int = {1: 2}[1]) -> str:\n    # inside\n    return a\n\nclass C(Base):\n    def m(self): ...\n\n# tail\nif X:\n    y()\n', ['"""Doc."""', "import os", "X = 1", "def f(a: int = {1: 2}[1]) -> str: { … }", "class C(Base): { … }", "# tail"], ["if X: { … }"]),
        ("rust", "// top\nuse a::b;\npub struct S { x: u8 }\nimpl S {\n  fn m(&self) {}\n}\npub fn f(x: u8) -> u8 {\n  x\n}\nconst N: u8 = 1;\n#[derive(Debug)]\nenum E { A }\nlet_me!();\n", ["// top", "use a::b;", "pub struct S { x: u8 }", "impl S { … }", "pub fn f(x: u8) -> u8 { … }", "const N: u8 = 1;", "#[derive(Debug)]", "enum E { A }"], []),
        ("typescript", "import a from 'a';\ninterface I { x: number }\nexport function e() { return 1; }\nfunction f(x: string): void {\n  g();\n}\nclass K extends L {\n  m() {}\n}\nif (a) { b(); }\n", ["import a from 'a';", "interface I { x: number }", "export function e() { return 1; }", "function f(x: string): void { … }", "class K extends L { … }"], ["if (a) { … }"]),
        ("go", "package p\n\nimport \"fmt\"\n\ntype T struct {\n\tx int\n}\n\nfunc (t T) M() int {\n\treturn t.x\n}\n", ["package p", 'import "fmt"', "type T struct {\n\tx int\n}", "func (t T) M() int { … }"], []),
        ("java", "package p;\nimport a.B;\n/** doc */\npublic class X extends Y {\n  void m() {}\n}\ninterface I { void n(); }\n", ["package p;", "import a.B;", "/** doc */", "public class X extends Y { … }", "interface I { void n(); }"], []),
        ("c", "#include <a.h>\n#define N 1\ntypedef int t;\nint g(int);\nstatic int f(int x) {\n  return x;\n}\nstruct s { int x; };\n", ["#include <a.h>", "#define N 1", "typedef int t;", "int g(int);", "static int f(int x) { … }", "struct s { int x; };"], []),
    ],
)
def test_compression(syntax, source, signatures, skeleton):
    got = compress.compress(source, syntax, "signatures")
    assert got.content.split("\n\n") == signatures and got.items == len(signatures) and not got.had_parse_errors
    more = compress.compress(source, syntax, "skeleton")
    assert all(x in more.content for x in [*signatures, *skeleton]) and more.items == len(signatures) + len(skeleton)


def test_modes():
    assert compress.compress("x = 1", "python", "none") == ("x = 1", 0, False)
    assert compress.compress("f(", "python", "signatures").had_parse_errors
    assert compress.compress("", "rust", "skeleton") == ("", 0, False)
    with pytest.raises(ValueError):
        compress.compress("", "rust", "all")
    assert compress.syntax_of("Golang") is None and compress.syntax_of("Golang", True) == "go" and compress.syntax_of(None) is None


@pytest.mark.parametrize("syntax", sorted(masking._STRINGS))
@given(text=st.text(st.sampled_from("ab \n\"'`/*#{}()[];:=\\rR<>,@_"), max_size=60))
def test_any_source(syntax, text):
    masked = masking.mask(text, syntax)
    assert len(masked) == len(text) and masked.count("\n") == text.count("\n")
    imports.extract(text, syntax)
    for mode in compress.MODES:
        compress.compress(text, syntax, mode)


def test_columns(spark):
    rows = [("a.py", bytearray(b"import x\ndef f():\n  1\n")), ("b.go", bytearray(b'import "x"')), ("c.md", bytearray(b"import x")), ("d.py", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    from pyspark.sql import functions as F

    from lignum.functions import paths

    lang = paths.language(F.col("path"))
    got = {r.path: r for r in df.select("path", imports.imports_of(F.col("content"), F.col("path"), lang).alias("i"), compress.compressed(F.col("content"), lang, "signatures").alias("c")).collect()}
    assert got["a.py"].i[0].import_path == "x" and got["a.py"].c.items == 2 and got["b.go"].i is None and got["c.md"].c is None and got["d.py"].i is None
