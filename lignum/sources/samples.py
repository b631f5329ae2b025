"""Rows of `documents` as a tree of source files that import each other, with the document's text as comments."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import files_of


class Sample(NamedTuple):
    """@0 is the file's number in its language, @1, @2 and @3 the next ones."""

    path: str
    lines: tuple[str, ...]
    comment: str
    odd_path: str | None = None


SAMPLES = (
    Sample(
        "crate/src/a@0.rs",
        ("use crate::a@1;", "use super::a@2;", "// use crate::nothing;", "use std::io::{Read, Write};", "pub use self::inner::Thing;", "", "/// Adds.", "pub fn add@0(a: u32) -> u32 {", '    let s = "use crate::a@3;";', "    use crate::a@3;", "    use crate::a@1::Point;", "    a + 1", "}", "", "struct Point { x: u32 }"),
        "// ",
    ),
    Sample(
        "py/pkg/n@0.py",
        ('"""import fake"""', "from .n@1 import x", "import os, json", "import py.pkg.n@2 as q", "from py.pkg.n@2 import (", "    y,", ")", "# import nothing", "", "@cached", "def run(a: int,", "        b: int) -> int:", "    from ..pkg.n@3 import z", "    return a", "", "class Kept:", "    x = 1", "", "LIMIT = 10"),
        "# ",
    ),
    Sample(
        "web/c@0.ts",
        ('import { x } from "./c@1";', 'import "../web/c@2.ts";', "export * from './c@3';", 'const q = require("react");', '// import "./c@1";', "const s = `import './no'`;", "", "export interface Shape { size: number }", "function area(s: Shape): number {", "  return s.size;", "}", "class Box { side = 1; }"),
        "// ",
    ),
    Sample(
        "app/src/com/acme/T@0.java",
        ("package com.acme;", "import com.acme.T@1;", "import static com.acme.T@2;", "import com.acme.T@3.*;", "import java.util.List;", "/* import com.acme.No; */", "public class T@0 {", '  String s = "import com.acme.T@1;";', "  int f() { return 1; }", "}"),
        "// ",
    ),
    Sample(
        "c/s@0.c",
        ('#include "s@1.h"', "#include <stdio.h>", '#include "c/s@2.c"', '// #include "s@3.h"', "", "int add@0(int a) {", '  puts("#include <x.h>");', "  return a + 1;", "}", "struct point { int x; };"),
        "// ",
        "c/s@0.h",
    ),
    Sample(
        "js/d@0/index.js",
        ("import x from './../d@1';", "const y = require('../d@2/index.js');", "export { z } from 'lib';", "", "export default function main() {", "  return import('./lazy');", "}", "function helper() { return 1; }"),
        "// ",
    ),
)


def _filled(text: str, number: Column) -> Column:
    out = F.lit(text)
    for k in range(4):
        if f"@{k}" in text:
            out = F.replace(out, F.lit(f"@{k}"), (number + k).cast("string"))
    return out


def source_files(documents: DataFrame) -> DataFrame:
    """(path, size_bytes, content): doc_id picks the language and the number in it."""
    number = F.expr(f"doc_id div {len(SAMPLES)}")
    path, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, s in enumerate(SAMPLES):
        mine = F.col("doc_id") % len(SAMPLES) == k
        named = _filled(s.path, number)
        if s.odd_path is not None:
            named = F.when(number % 2 == 1, _filled(s.odd_path, number)).otherwise(named)
        told = F.concat(F.lit(s.comment), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n" + s.comment)), F.lit("\n"))
        path, body = F.when(mine, named).otherwise(path), F.when(mine, F.concat(_filled("\n".join(s.lines) + "\n", number), told)).otherwise(body)
    return documents.filter("doc_id is not null").select(*files_of(path, body))
