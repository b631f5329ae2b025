"""The driver's queries of imports, resolution, cycles, compression and packs, each with its SQL twin.

The twins state what each line of `sources.samples` means by hand: no rule of
the code under test is used to tell what it should find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compress, excerpts, graph, loc, select
from .functions import paths
from .plans import context
from .sources import samples, tables
from .sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
N = len(samples.SAMPLES)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _filled(value: str) -> str:
    """SQL of a text with the numbers in their places."""
    out = _text(value)
    for k in range(4):
        if f"@{k}" in value:
            out = f"replace({out}, '@{k}', CAST(m + {k} AS VARCHAR))"
    return f"({out})"


#: by sample: (import, line, path that it leads to or None), in order of place
_IMPORTS: tuple[tuple[tuple[str, int, str | None], ...], ...] = (
    (("crate::a@1", 1, "crate/src/a@1.rs"), ("super::a@2", 2, "crate/src/a@2.rs"), ("std::io::Read", 4, None), ("std::io::Write", 4, None), ("pub use self::inner::Thing", 5, None), ("crate::a@3", 10, "crate/src/a@3.rs"), ("crate::a@1::Point", 11, "crate/src/a@1.rs")),
    ((".n@1", 2, "py/pkg/n@1.py"), ("os", 3, None), ("json", 3, None), ("py.pkg.n@2 as q", 4, None), ("py.pkg.n@2", 5, "py/pkg/n@2.py"), ("..pkg.n@3", 13, "py/pkg/n@3.py")),
    (("./c@1", 1, "web/c@1.ts"), ("../web/c@2.ts", 2, "web/c@2.ts"), ("./c@3", 3, "web/c@3.ts"), ("react", 4, None)),
    (("com.acme.T@1", 2, "app/src/com/acme/T@1.java"), ("com.acme.T@2", 3, "app/src/com/acme/T@2.java"), ("com.acme.T@3.*", 4, None), ("java.util.List", 5, None)),
    (("s@1.h", 1, "c/s@1.h"), ("<stdio.h>", 2, None), ("c/s@2.c", 3, "c/s@2.c")),
    (("./../d@1", 1, "js/d@1/index.js"), ("../d@2/index.js", 2, "js/d@2/index.js"), ("lib", 3, None)),
)
_LANGUAGES = ("Rust", "Python", "TypeScript", "Java", "C", "JavaScript")
#: by sample: what stays of it without bodies
_KEPT = (
    ("use crate::a@1;", "use super::a@2;", "// use crate::nothing;", "use std::io::{Read, Write};", "pub use self::inner::Thing;", "/// Adds.", "pub fn add@0(a: u32) -> u32 { … }", "struct Point { x: u32 }"),
    ('"""import fake"""', "from .n@1 import x", "import os, json", "import py.pkg.n@2 as q", "from py.pkg.n@2 import (\n    y,\n)", "# import nothing", "class Kept: { … }", "LIMIT = 10"),
    ('import { x } from "./c@1";', 'import "../web/c@2.ts";', "export * from './c@3';", 'const q = require("react");', '// import "./c@1";', "const s = `import './no'`;", "export interface Shape { size: number }", "function area(s: Shape): number { … }", "class Box { … }"),
    ("package com.acme;", "import com.acme.T@1;", "import static com.acme.T@2;", "import com.acme.T@3.*;", "import java.util.List;", "/* import com.acme.No; */", "public class T@0 { … }"),
    ('#include "s@1.h"', "#include <stdio.h>", '#include "c/s@2.c"', '// #include "s@3.h"', "int add@0(int a) { … }", "struct point { int x; };"),
    ("import x from './../d@1';", "const y = require('../d@2/index.js');", "export { z } from 'lib';", "export default function main() {\n  return import('./lazy');\n}", "function helper() { … }"),
)
#: by sample: lines of code, comment and nothing, without the document's text
_COUNTS = ((11, 2, 2), (14, 2, 3), (10, 1, 1), (9, 1, 0), (8, 1, 1), (7, 0, 1))


def _by_language(values: list[str]) -> str:
    return "case doc_id % " + str(N) + " " + " ".join(f"when {k} then {v}" for k, v in enumerate(values)) + " end"


_ODD = "(doc_id % 6 = 4 and m % 2 = 1)"
_PATH = _by_language([f"case when m % 2 = 1 then {_filled(s.odd_path)} else {_filled(s.path)} end" if s.odd_path else _filled(s.path) for s in samples.SAMPLES])
_BODY = _by_language([_filled("\n".join(s.lines) + "\n") for s in samples.SAMPLES])
_MARK = _by_language([_text(s.comment) for s in samples.SAMPLES])
_EDGE_ROWS = ", ".join(f"({k}, {o}, {_text(path)}, {line}, {_text(to) if to else 'null'})" for k, rows in enumerate(_IMPORTS) for o, (path, line, to) in enumerate(rows))
_numbered = lambda c: f"replace(replace(replace({c}, '@1', CAST(m + 1 AS VARCHAR)), '@2', CAST(m + 2 AS VARCHAR)), '@3', CAST(m + 3 AS VARCHAR))"
_FILES = f"""
numbered as (select doc_id, doc_id // {N} as m, coalesce(text, '') as t from documents where doc_id is not null),
files as (select doc_id, m, {_PATH} as path, {_BODY} || {_MARK} || replace(t, chr(10), chr(10) || {_MARK}) || chr(10) as body, string_split(t, chr(10)) as told, {_MARK} as mark from numbered),
analysed as (select *, {_by_language([_text(x) for x in _LANGUAGES])} as language from files where strlen(body) <= 524288 and not {_ODD})"""
_EDGES = f"""{_FILES},
rows(kind, ord, import_path, line, goal) as (values {_EDGE_ROWS}),
asked as (select path as "from", CAST(ord AS INTEGER) as ord, {_numbered("import_path")} as import_path, CAST(line AS BIGINT) as line, {_numbered("goal")} as goal from analysed join rows on doc_id % {N} = kind),
edges as (select "from", ord, import_path, line, f.path as "to", f.path is not null as resolved from asked left join (select distinct path from files) f on goal = f.path)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.source_files(table(spark, sf_dir, "documents"))


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_of(_sources(spark, sf_dir))


def import_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of the files; those that aren't analysed have no language."""
    files = _sources(spark, sf_dir)
    edges = graph.written(graph.edges_of(files), "edges")
    return graph.degrees(graph.nodes_of(graph.analysed(files), edges), edges)


_NODES_SQL = f"""with {_EDGES.strip()},
nodes as (select path, max(language) as language from (select path, language from analysed union all select "to", null from edges where resolved) group by path),
o as (select "from" as path, count(*) as n from edges where resolved group by 1), i as (select "to" as path, count(*) as n from edges where resolved group by 1)
select path, language, coalesce(o.n, 0) as imports_count, coalesce(i.n, 0) as imported_by_count from nodes left join o using (path) left join i using (path)"""


def compressed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _sources(spark, sf_dir).select("path", "content", paths.language(F.col("path")).alias("language"))
    modes = ("signatures", "skeleton")
    known = named.filter(F.col("language").isin([*compress.SYNTAX]) & F.col("content").isNotNull())
    shown = known.select("path", F.posexplode(compress.compressed_all(F.col("content"), F.col("language"), modes)).alias("k", "c"))
    return shown.select("path", F.element_at(F.array(*map(F.lit, modes)), F.col("k") + 1).alias("mode"), "c.*")


_COMPRESSED_SQL = f"""with {_FILES.strip()},
kept as (select path, list_concat({_by_language(["[" + ", ".join(map(_filled, k)) + "]" for k in _KEPT])}, list_transform(told, lambda x: regexp_replace(mark || x, '\\s+$', ''))) as items from files where not {_ODD})
select path, mode, array_to_string(items, chr(10) || chr(10)) as content, CAST(len(items) AS BIGINT) as items, false as had_parse_errors from kept, (values ('signatures'), ('skeleton')) v(mode)"""


def loc_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loc.rollup(loc.with_counts(_sources(spark, sf_dir)))


_HEADER = "C Header File"
_LOC_SQL = f"""with {_FILES.strip()},
counted as (select case when {_ODD} then '{_HEADER}' else {_by_language([_text(x) for x in _LANGUAGES])} end as language, strlen(body) as size_bytes, len(told) as told,
  {", ".join(f"{_by_language([str(c[k]) for c in _COUNTS])} as {name}" for k, name in enumerate(loc.COUNTS))} from files)
select language, CAST(sum(code_lines) AS BIGINT) as code_lines, CAST(sum(comment_lines + told) AS BIGINT) as comment_lines, CAST(sum(empty_lines) AS BIGINT) as empty_lines, CAST(sum(size_bytes) AS BIGINT) as size_bytes, count(*) as files
from counted group by rollup (language)"""


# rings of four customers' files, each with a tail that leads into it and a leaf that it leads to
def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 4").alias("r"), (F.col("c_custkey") % 4).alias("k"))
    node = lambda r, k: F.concat(F.lit("r"), r.cast("string"), F.lit("/"), k.cast("string"), F.lit(".py"))
    me, r = node(F.col("r"), F.col("k")), F.col("r").cast("string")
    after = F.struct(me.alias("from"), F.lit(1).alias("ord"), node(F.col("r"), (F.col("k") + 1) % 4).alias("to"))
    tail = F.struct(F.concat(F.lit("a/"), r, F.lit(".py")).alias("from"), F.lit(0).alias("ord"), me.alias("to"))
    leaf = F.struct(me.alias("from"), F.lit(0).alias("ord"), F.concat(F.lit("z/"), r, F.lit(".py")).alias("to"))
    links = c.select("*", F.explode(F.array(after, tail, leaf)).alias("e")).filter("e.from not like 'a/%' or k = 1").select("e.*")
    known = c.select(me.alias("path")).unionByName(c.select(F.concat(F.lit("z/"), r, F.lit(".py")).alias("path"))).distinct()
    return links.withColumns({"import_path": F.col("to"), "line": F.lit(1).cast("bigint"), "keys": F.array(F.concat(F.lit("f:"), "to"))}).drop("to"), known


def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, known = _rings(spark, sf_dir)
    return graph.cycles_table(spark, graph.resolve(links, graph.known_keys(known)))


#: the search starts at the first path in order, which is a tail's where there is one, so such a ring begins at 1
_CYCLES_SQL = """
with rings as (select c_custkey // 4 as r from customer group by 1 having count(distinct c_custkey) = 4)
select row_number() over (order by 'a/' || r || '.py') - 1 as cycle_id, list_transform([1, 2, 3, 0, 1], lambda k: 'r' || r || '/' || k || '.py') as files from rings"""


# packs of the files of `queries._placed`, with their texts
_FOCUSES = (select.Focus("lib13/util.py", False), select.Focus("src/m3", True), select.Focus("src/m4/tests/unit.py", False))
BUDGET = 40_000
ROOM = 36_000  # of it for excerpts


def _pack(spark: SparkSession, sf_dir: str) -> context.ContextReport:
    from . import queries

    text = tables.rewritten(F.coalesce("text", F.lit("")))
    files = table(spark, sf_dir, "documents").select(*tables.files_of(queries._place(), text))
    return context.report(files, BUDGET, _FOCUSES, queries._changed(spark, sf_dir))


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, f["relative_path"], f["selection_class"], f["estimated_tokens"], f["excerpt"]["line_end"], f["truncated"], f["excerpt"]["content"]) for k, f in enumerate(_pack(spark, sf_dir).files)]
    return spark.createDataFrame(rows, "place int, path string, class string, tokens bigint, line_end bigint, truncated boolean, content string")


def context_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(g["label"], g["files"], g["estimated_tokens"], g["truncated_files"]) for g in _pack(spark, sf_dir).groups]
    return spark.createDataFrame(rows, "label string, files bigint, estimated_tokens bigint, truncated_files bigint")


def _pack_sql(class_sql: str, place_sql: str) -> str:
    """The walk in rank order, a file a step; only the first files that could fit are looked at."""
    body = "replace(replace(coalesce(text, ''), '. ', chr(10) || chr(10) || '# '), ', ', chr(13) || chr(10) || '  ')"
    sized = class_sql.replace("strlen(coalesce(text, ''))", f"strlen({body})").replace("select doc_id, ", f"select doc_id, {body} as body, ", 1).replace("as (select path, language, size_bytes, changed_path", "as (select doc_id, path, language, size_bytes, changed_path")
    return f"""with recursive {sized.strip()},
-- lines of bytes: no text has a lone carriage return
parts as (select doc_id, unnest(string_split(body, chr(10))) as x, unnest(range(0, len(string_split(body, chr(10))))) as i, len(string_split(body, chr(10))) as n from placed),
begun as (select *, sum(strlen(x) + 1) over (partition by doc_id order by i) - strlen(x) - 1 as begins from parts),
wide as (select distinct doc_id from begun where least(strlen(rtrim(x, chr(13))), 32768 - begins) > 2000),
lined as (select doc_id, i, rtrim(x, chr(13)) as line, strlen(rtrim(x, chr(13))) as b from begun where i < n - 1 or x <> ''),
first_text as (select doc_id, min(i) as f from lined where b > 0 group by doc_id),
upto as (select l.doc_id, l.i, case when f is null or l.i < f then 0 else sum(case when l.i >= f then b + CAST(l.i > f AS INTEGER) else 0 end) over (partition by l.doc_id order by l.i) end as s, line, f from lined l left join first_text t on l.doc_id = t.doc_id),
texts as (select doc_id, list(CAST(s AS BIGINT) order by i) as sums, list(line order by i) as all_lines, any_value(f) as f from upto group by doc_id),
ordered as (select row_number() over (order by rank, size_bytes, path) as k, path, class, size_bytes, doc_id from fit where doc_id not in (select doc_id from wide)),
few as (select o.*, coalesce(sums, []) as sums, coalesce(all_lines, []) as all_lines, f from ordered o left join texts using (doc_id) where k <= 2000),
costed as materialized (select *, class = 'focused-file' as focused, greatest(1, (size_bytes + 3) // 4) as guess, greatest(1, (strlen(array_to_string(all_lines, chr(10))) + 3) // 4) as whole from few),
walk as (
  select CAST(0 AS BIGINT) as k, CAST(0 AS BIGINT) as used, false as partial, CAST(null AS VARCHAR) as path, CAST(null AS VARCHAR) as class, CAST(0 AS BIGINT) as tokens, CAST(0 AS BIGINT) as line_end, false as truncated, CAST(null AS VARCHAR) as content
  union all
  select k, used + tokens, truncated and allowed < case when focused then 4000 else 2000 end, path, class, tokens, line_end, truncated, content from (
    select *, case when full_fits then array_to_string(all_lines, chr(10)) else array_to_string(all_lines[coalesce(f, line_end) + 1:line_end], chr(10)) end as content,
      case when full_fits then false else line_end < len(all_lines) end as truncated,
      CAST(case when full_fits then whole else greatest(1, (case when line_end = 0 then 0 else sums[line_end] end + 3) // 4) end AS BIGINT) as tokens from (
      select *, CAST(case when full_fits then len(all_lines) else len(list_filter(sums[1:case when focused then 240 else 120 end], lambda s: s <= 4 * limit_tokens)) end AS BIGINT) as line_end from (
        select *, size_bytes <= 4096 and guess <= limit_tokens as full_fits from (
          select c.*, w.used, {ROOM} - w.used as allowed, least({ROOM} - w.used, case when focused then 4000 else 2000 end) as limit_tokens
          from walk w join costed c on c.k = w.k + 1
          where {ROOM} - w.used > 0 and not w.partial and not ({ROOM} - w.used < case when focused then 1000 else 500 end and guess > {ROOM} - w.used))))))
"""


def _packs(class_sql: str, place_sql: str) -> dict[str, str]:
    walk = _pack_sql(class_sql, place_sql)
    group = "case class " + " ".join(f"when '{c}' then '{g}'" for c, g in (("focused-file", "Focus"), ("focused-descendant", "Focus"), ("diff-file", "Changes"), ("manifest", "Project Metadata"), ("workflow", "Workflows"), ("entrypoint", "Entrypoints"), ("adjacent-test", "Testing"), ("general", "General"))) + " end"
    return {
        "context_pack": walk + " select CAST(k - 1 AS INTEGER) as place, path, class, tokens, line_end, truncated, content from walk where k > 0",
        "context_groups": walk + f" select {group} as label, count(*) as files, CAST(sum(tokens) AS BIGINT) as estimated_tokens, count(*) filter (where truncated) as truncated_files from walk where k > 0 group by 1",
    }


QUERIES: dict[str, Query] = {
    "import_edges": import_edges,
    "import_nodes": import_nodes,
    "compressed_sources": compressed_sources,
    "loc_sources": loc_sources,
    "graph_cycles": graph_cycles,
    "context_pack": context_pack,
    "context_groups": context_groups,
}

ORACLES: dict[str, str] = {
    "import_edges": f"with {_EDGES.strip()} select * from edges",
    "import_nodes": _NODES_SQL,
    "compressed_sources": _COMPRESSED_SQL,
    "loc_sources": _LOC_SQL,
    "graph_cycles": _CYCLES_SQL,
}


def oracles(class_sql: str, place_sql: str) -> dict[str, str]:
    return ORACLES | _packs(class_sql, place_sql)
