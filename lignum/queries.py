"""The driver's queries of the library's own operators, each with its SQL twin.

Each runs over whole tables. `documents` and `pages` become files by
`sources.tables`; graphs come from `lineitem`, whose orders link suppliers,
parts and customers' files by several imports each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code_queries
from .functions import paths
from .functions.tokens import estimate
from .operators import excerpts, graph, ignore, loc, select
from .registry import LANGUAGES, by_extension, by_name
from .sources import corpus, tables
from .sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

_LINES_SQL = "case when regexp_split_to_array({t}, '\\r\\n|\\r|\\n')[-1] = '' then regexp_split_to_array({t}, '\\r\\n|\\r|\\n')[:-2] else regexp_split_to_array({t}, '\\r\\n|\\r|\\n') end"


def _list_sql(values: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_DOC_FILES_SQL = f"""
files as (select concat_ws('/', source, lang, CAST(doc_id AS VARCHAR) || '.' || {_list_sql(tables.EXTENSIONS)}[doc_id % 4 + 1]) as path, doc_id,
  replace(replace(coalesce(text, ''), '. ', chr(10) || chr(10) || '# '), ', ', chr(13) || chr(10) || '  ') as body from documents)"""
_LANGUAGE_OF_DOC = {e: by_extension()[e] for e in tables.EXTENSIONS}
_TOKEN = {"md": None, "json": None, "sh": "#", "tex": "%"}
_LOC_SQL = f"""
with {_DOC_FILES_SQL.strip()},
named as (select path, body, case regexp_extract(path, '[^.]*$') {" ".join(f"when '{e}' then '{n}'" for e, n in _LANGUAGE_OF_DOC.items())} end as language, case regexp_extract(path, '[^.]*$') {" ".join(f"when '{e}' then '{t}'" for e, t in _TOKEN.items() if t)} end as token from files),
cut as (select path, body, language, token, {_LINES_SQL.format(t="body")} as l from named),
counted as (select path, language, strlen(body) as size_bytes, len(l) as n,
  len(list_filter(l, lambda x: regexp_full_match(x, '[ \\t\\f]*'))) as empty_lines,
  len(list_filter(l, lambda x: token is not null and starts_with(ltrim(x, ' ' || chr(9) || chr(12)), token))) as comment_lines from cut),
counts as (select path, language, size_bytes, n - empty_lines - comment_lines as code_lines, comment_lines, empty_lines from counted)"""
_SUMS_SQL = "CAST(sum(code_lines) AS BIGINT) as code_lines, CAST(sum(comment_lines) AS BIGINT) as comment_lines, CAST(sum(empty_lines) AS BIGINT) as empty_lines, CAST(sum(size_bytes) AS BIGINT) as size_bytes"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.document_files(table(spark, sf_dir, "documents"))


def loc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loc.by_language(loc.with_counts(_documents(spark, sf_dir)))


def loc_rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loc.rollup(loc.with_counts(_documents(spark, sf_dir)))


def loc_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loc.totals(loc.with_counts(_documents(spark, sf_dir)))


def loc_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loc.with_counts(tables.page_files(table(spark, sf_dir, "pages"))).select("path", *loc.SUMS)


#: a page's block comments lie within lines here, so SQL can cut them out; a line that had one isn't empty
_HTML_SQL = f"""
with cut as (select page_id, coalesce(html, '') as h, {_LINES_SQL.format(t="coalesce(html, '')")} as l from pages),
rest as (select page_id, h, l, list_transform(l, lambda x: regexp_full_match(regexp_replace(x, '<!--.*?-->', '', 'g'), '[ \\t\\f]*')) as bare, list_transform(l, lambda x: contains(x, '<!--')) as noted from cut),
n as (select page_id, h, len(list_filter(bare, lambda b: not b)) as code, len(list_filter(list_zip(bare, noted), lambda z: z[1] and z[2])) as comment, len(l) as total from rest)
select 'pages/' || page_id || '.html' as path, CAST(code AS BIGINT) as code_lines, CAST(comment AS BIGINT) as comment_lines, CAST(total - code - comment AS BIGINT) as empty_lines, CAST(strlen(h) AS BIGINT) as size_bytes from n"""

_IGNORED = ("*.json", "7[0-4]*", "^src(1|3)/", "/1\\d+\\.")


def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignore.keep(_documents(spark, sf_dir).select("path"), _IGNORED)


_IGNORE_SQL = f"""
with {_DOC_FILES_SQL.strip()}, named as (select path, regexp_extract(path, '[^/]*$') as name from files)
select path from named where not regexp_full_match(name, '.*\\.json') and not regexp_full_match(name, '7[0-4].*') and not regexp_matches(path, '^src(1|3)/') and not regexp_matches(path, '/1\\d+\\.')"""

#: names that try the lookup: whole names, letter case, dots at either end, unknown ones
_NAMES = ("Makefile", "makefile", "Dockerfile", "x.py", "x.PY", ".bashrc", "a.b.rs", "x.", "plain", "x.htaccess", ".htaccess", "lib.c++", "y.tsx", "z.h", "q.vimrc", "w.unknown")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", name).alias("path"))


def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", "path", paths.language(F.col("path")).alias("language"), paths.extension(F.col("path")).alias("extension"))


def _values(pairs: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())


_LOOKUP_SQL = f"""
with named as (select doc_id, {_list_sql(_NAMES)}[doc_id % {len(_NAMES)} + 1] as name, concat_ws('/', source, lang, {_list_sql(_NAMES)}[doc_id % {len(_NAMES)} + 1]) as path from documents),
parts as (select *, case when regexp_matches(name, '^.+\\.[^.]*$') then regexp_extract(name, '^.+\\.([^.]*)$', 1) end as extension from named),
e(k, v) as (values {_values(by_extension())}), n(k, v) as (values {_values(by_name())})
select doc_id, path, coalesce(n.v, e.v) as language, extension from parts left join n on name = n.k left join e on extension = e.k"""


#: folders and names that fall into each class, by doc_id % 8
_PLACES = ("docs/guide/{}.md", ".github/workflows/{}.yml", "pkg{}/README.md", "src/m{}/main.rs", "src/m{}/tests/unit.py", "lib{}/util.py", "node_modules/m{}/index.js", "pkg{}/pyproject.toml")
_FOCUSES = (select.Focus("lib13/util.py", False), select.Focus("src/m3", True), select.Focus("src/m4/tests/unit.py", False))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(_place().alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size_bytes"))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("toxic = 1").select(_place().alias("path"))


def _place() -> Column:
    """A document's path."""
    path = F.lit(None).cast("string")
    for i, p in enumerate(_PLACES):
        a, b = p.split("{}")
        path = F.when(F.col("doc_id") % len(_PLACES) == i, F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(b))).otherwise(path)
    return path


_PATH_SQL = "case doc_id % 8 " + " ".join(f"when {i} then '{a}' || doc_id || '{b}'" for i, (a, b) in enumerate(p.split("{}") for p in _PLACES)) + " end"
_LANG_SQL = "case doc_id % 8 when 0 then 'Markdown' when 1 then 'YAML' when 2 then 'Markdown' when 3 then 'Rust' when 4 then 'Python' when 5 then 'Python' when 6 then 'JavaScript' else 'TOML' end"
_CLASS_SQL = f"""
placed as (select doc_id, {_PATH_SQL} as path, {_LANG_SQL} as language, CAST(strlen(coalesce(text, '')) AS BIGINT) as size_bytes from documents),
diff as (select distinct {_PATH_SQL} as changed_path from labels where toxic = 1),
classed as (select path, language, size_bytes, changed_path is not null as changed,
  case when path = 'lib13/util.py' then 'focused-file' when path = 'src/m3' or path like 'src/m3/%' then 'focused-descendant' when path = 'src/m4/tests/unit.py' then 'focused-file'
       when changed_path is not null then 'diff-file' when doc_id % 8 = 1 then 'workflow' when doc_id % 8 in (2, 7) then 'manifest' when doc_id % 8 = 3 then 'entrypoint' when doc_id % 8 = 4 then 'adjacent-test' else 'general' end as class
  from placed left join diff on path = changed_path),
seen as (select *, {"case class " + " ".join(f"when '{c}' then {r}" for c, (r, _) in select.CLASSES.items()) + " end"} as rank from classed where path not like 'node_modules/%' or changed or class like 'focused%'),
fit as (select * from seen where size_bytes between 1 and 1048576)"""


def _considered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.considered(_placed(spark, sf_dir), _FOCUSES, _changed(spark, sf_dir))


def selection_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.ranked(select.candidates(_considered(spark, sf_dir))).select("path", "language", "size_bytes", "class", "class_rank")


_RANK_SQL = f"with {_CLASS_SQL.strip()} select path, language, size_bytes, class, row_number() over (partition by class order by size_bytes, path) as class_rank from fit"


def dominant_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.dominant_languages(_considered(spark, sf_dir))


_DOMINANT_SQL = f"with {_CLASS_SQL.strip()} select language, count(*) as files, CAST(sum(size_bytes) AS BIGINT) as size_bytes from seen group by language"

_BUDGET = 100_000


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = select.candidates(_considered(spark, sf_dir))
    return excerpts.budget_frontier(kept, _BUDGET).select("path", "class", estimate(F.col("size_bytes")).alias("tokens"), "prior")


_BUDGET_SQL = f"""with {_CLASS_SQL.strip()}, costed as (select *, greatest(1, (size_bytes + 3) // 4) as tokens from fit),
run as (select *, coalesce(sum(tokens) over (order by rank, size_bytes, path rows between unbounded preceding and 1 preceding), 0) as prior from costed)
select path, class, CAST(tokens AS BIGINT) as tokens, CAST(prior AS BIGINT) as prior from run where prior < {_BUDGET}"""


def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = select.candidates(_considered(spark, sf_dir)).withColumn("tokens", estimate(F.col("size_bytes")))
    return kept.groupBy(select.group_of(F.col("class")).alias("group")).agg(F.count("*").alias("files"), F.sum("tokens").alias("estimated_tokens"), F.count_if(F.col("tokens") > 2000).alias("over_cap"))


_GROUP_SQL = f"""with {_CLASS_SQL.strip()}, costed as (select *, greatest(1, (size_bytes + 3) // 4) as tokens from fit)
select case class {" ".join(f"when '{c}' then '{g}'" for c, (_, g) in select.CLASSES.items())} end as "group", count(*) as files, CAST(sum(tokens) AS BIGINT) as estimated_tokens, count(*) filter (where tokens > 2000) as over_cap from costed group by 1"""


def diff_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.with_changes(_placed(spark, sf_dir), _changed(spark, sf_dir)).filter("changed").select("path", "size_bytes")


_DIFF_SQL = f"with {_CLASS_SQL.strip()} select path, size_bytes from placed semi join diff on path = changed_path"


HEAD_LINES, HEAD_TOKENS = 120, 500


def head_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(tables.rewritten(F.coalesce("text", F.lit(""))), "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", excerpts.heads(content, HEAD_LINES, HEAD_TOKENS).alias("h")).select("doc_id", "h.*")


#: blank lines at the top are counted and not shown; a first line that is too long is cut between characters
_HEAD_SQL = f"""with {_DOC_FILES_SQL.strip()}, cut as (select doc_id, {_LINES_SQL.format(t="body")} as l from files),
bytes as (select doc_id, l, list_transform(l, lambda x: strlen(x)) as b, coalesce(list_position(list_transform(l, lambda x: strlen(x) > 0), true), len(l) + 1) as f from cut),
sums as (select *, list_transform(range(1, least({HEAD_LINES}, len(l)) + 1), lambda k: case when k < f then 0 else list_sum(b[f:k]) + k - f end) as s from bytes),
fit as (select *, len(list_filter(s, lambda x: x <= {4 * HEAD_TOKENS})) as k from sums),
seen as (select *, k < least({HEAD_LINES}, len(l)) and f = k + 1 as clipped from fit)
select doc_id, case when clipped then left(l[f], CAST(len(list_filter(range(1, {4 * HEAD_TOKENS} + 1), lambda n: n <= length(l[f]) and strlen(left(l[f], n)) <= {4 * HEAD_TOKENS})) AS BIGINT)) else array_to_string(l[f:k], chr(10)) end as content,
  CAST(k + CAST(clipped AS INTEGER) AS BIGINT) as line_end, k < least({HEAD_LINES}, len(l)) or k < len(l) as truncated from seen"""


# graphs: suppliers' files import those of their parts, parts' files those of a supplier of another order
def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from, ord, import_path, line, keys) of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    supplier, part = F.concat(F.lit("s/"), F.col("l_suppkey").cast("string"), F.lit(".py")), F.concat(F.lit("p/"), (F.col("l_partkey") % 150).cast("string"), F.lit(".py"))
    gone = F.concat(F.lit("x/"), (F.col("l_partkey") % 1000).cast("string"), F.lit(".py"))
    even = F.col("l_orderkey") % 2 == 0
    source, goal = F.when(even, supplier).otherwise(part), F.when(F.col("l_quantity") > 45, gone).when(even, part).otherwise(supplier)
    rows = li.select(source.alias("from"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), goal.alias("import_path"), F.col("l_linenumber").cast("bigint").alias("line"))
    return rows.withColumn("keys", F.array(F.concat(F.lit("f:"), "import_path")))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(analysed files, edges): files without the parts whose number ends in 9."""
    links = _links(spark, sf_dir)
    known = links.select(F.col("from").alias("path")).filter("path not like 'p/%9.py'").distinct()
    return known.withColumn("language", F.lit("Python")), graph.resolve(links, graph.known_keys(known))


_EDGES_SQL = """
links as (select case when l_orderkey % 2 = 0 then 's/' || l_suppkey || '.py' else 'p/' || l_partkey % 150 || '.py' end as "from", l_orderkey * 8 + l_linenumber as ord,
  case when l_quantity > 45 then 'x/' || l_partkey % 1000 || '.py' when l_orderkey % 2 = 0 then 'p/' || l_partkey % 150 || '.py' else 's/' || l_suppkey || '.py' end as import_path, CAST(l_linenumber AS BIGINT) as line from lineitem),
known as (select distinct "from" as path from links where "from" not like 'p/%9.py'),
edges as (select "from", ord, import_path, line, path as "to", path is not null as resolved from links left join known on import_path = path)"""


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


def graph_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_counts(_graph(spark, sf_dir)[1])


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, edges = _graph(spark, sf_dir)
    return graph.degrees(graph.nodes_of(known, edges), edges)


_DEGREES_SQL = f"""{_EDGES_SQL.strip()},
nodes as (select path, 'Python' as language from known),
degrees as (select path, language, (select count(*) from edges where resolved and "from" = path) as imports_count, (select count(*) from edges where resolved and "to" = path) as imported_by_count from nodes)"""


def graph_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top(_degrees(spark, sf_dir), "imported_by_count")


_ROOT = "s/1.py"


def _reach(spark: SparkSession, sf_dir: str, depth: int | None, reverse: bool) -> DataFrame:
    known, edges = _graph(spark, sf_dir)
    return graph.reachable(known.filter(F.col("path") == _ROOT), edges, depth, reverse)


def _reach_sql(depth: int | None, reverse: bool) -> str:
    """Every path keeps the round that first reached it."""
    a, b = ('"to"', '"from"') if reverse else ('"from"', '"to"')
    bound = "" if depth is None else f"and w.distance <= {depth}"
    return f"""with recursive {_EDGES_SQL.strip()}, pairs as (select distinct "from", "to" from edges where resolved),
walk(path, distance) using key (path) as (select path, 0 from known where path = '{_ROOT}' union
  select p.{b}, min(w.distance + 1) from walk w join pairs p on p.{a} = w.path where p.{b} not in (select path from recurring.walk) {bound} group by 1)
select path, distance from walk"""


def graph_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, edges = _graph(spark, sf_dir)
    return graph.subset(edges, known.filter(graph.under(F.col("path"), ["s/1.py", "p"])))


_SUBSET_SQL = f"""with {_EDGES_SQL.strip()}, chosen as (select path from known where path = 's/1.py' or path like 'p/%')
select e.* from edges e where "from" in (select path from chosen) and (not resolved or "to" in (select path from chosen))"""


def _java(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part")
    name = F.translate("p_type", " ", "/")
    known = parts.filter("p_partkey % 2 = 0").select(F.concat(F.lit("src/"), F.translate("p_brand", "#", ""), F.lit("/"), name, F.lit(".java")).alias("path")).distinct()
    tails = F.split(name, "/")
    keys = F.flatten(F.transform(F.sequence(F.lit(1), F.size(tails)), lambda k: F.array(*[F.concat(F.lit(p), F.array_join(F.slice(tails, k, F.size(tails)), "/"), F.lit(".java")) for p in ("f:", "j:")])))
    asked = parts.select(F.concat(F.lit("app/"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("from"), F.lit(0).alias("ord"), F.translate(name, "/", ".").alias("import_path"), F.lit(1).cast("bigint").alias("line"), keys.alias("keys"))
    return asked, known


def java_suffix_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, known = _java(spark, sf_dir)
    return graph.resolve(asked, graph.known_keys(known)).select("from", "import_path", "to", "resolved")


_JAVA_SQL = """
with known as (select distinct 'src/' || replace(p_brand, '#', '') || '/' || replace(p_type, ' ', '/') || '.java' as path from part where p_partkey % 2 = 0),
asked as (select 'app/' || p_partkey || '.java' as "from", replace(p_type, ' ', '.') as import_path, string_split(p_type, ' ') as w from part),
tails as (select "from", import_path, k, array_to_string(w[k:], '/') || '.java' as tail from (select *, unnest(range(1, len(w) + 1)) as k from asked)),
hits as (select "from", arg_min(path, struct_pack(k := k, inexact := path <> tail, path := path)) as "to" from tails join known on path = tail or ends_with(path, '/' || tail) group by "from")
select a."from", import_path, "to", "to" is not null as resolved from asked a left join hits h on a."from" = h."from\""""


def focus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a focus imports within two steps, and what depends on it within two."""
    known, edges = _graph(spark, sf_dir)
    root, edges = known.filter(F.col("path") == _ROOT), graph.written(edges.filter("resolved"), "edges")
    return graph.reachable(root, edges, 1).select("path").union(graph.reachable(root, edges, 1, True).select("path")).distinct()


def registry_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry beside the number of documents' files of each language."""
    n = _documents(spark, sf_dir).groupBy(paths.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))
    registry = spark.createDataFrame([(name, x.style, len(x.extensions) + len(x.names)) for name, x in LANGUAGES.items()], "language string, style string, patterns int")
    return registry.join(F.broadcast(n), "language", "left").na.fill(0, ["files"])


_REGISTRY_SQL = f"""with {_DOC_FILES_SQL.strip()}, n as (select regexp_extract(path, '[^.]*$') as ext, count(*) as files from files group by 1),
r(language, style, patterns) as (values {", ".join(f"('{n}', '{x.style}', {len(x.extensions) + len(x.names)})" for n, x in LANGUAGES.items())}),
e(k, v) as (values {_values(_LANGUAGE_OF_DOC)})
select language, style, patterns, coalesce(files, 0) as files from r left join e on v = language left join n on k = ext"""



def benchmark_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts of the made-up medium tree."""
    return loc.rollup(loc.with_counts(corpus.files(spark, corpus.DATASETS["medium"])))


#: by hand: (code, comment, empty) of the head, the repeated body and the tail of each template, and of the files at the root
_CORPUS_COUNTS = {
    "Rust": ("rs", (0, 1, 1), (3, 2, 1), (0, 0, 0)),
    "Python": ("py", (0, 1, 1), (2, 1, 1), (0, 0, 0)),
    "TypeScript": ("ts", (0, 1, 1), (1, 1, 1), (0, 0, 0)),
    "HTML": ("html", (2, 0, 0), (1, 1, 1), (1, 0, 0)),
    "JSON": ("json", (1, 0, 0), (1, 0, 1), (2, 0, 0)),
    "TOML": ("toml", (0, 1, 0), (2, 1, 1), (0, 0, 0)),
    "Shell Script": ("sh", (0, 1, 0), (1, 1, 1), (0, 0, 0)),
}
_ROOT_COUNTS = {"Makefile": ("Makefile", (2, 1, 0)), "Dockerfile": ("Dockerfile", (1, 1, 0))}


def _corpus_sql(d: corpus.Dataset) -> str:
    """A template's lines are known, so the counts are products."""
    each, n = d.modules * d.files, corpus.repeats(d)
    rows = []
    for language, (ext, *counts) in _CORPUS_COUNTS.items():
        a, b, c = (len(p) for p in corpus.TEMPLATES[ext])
        rows.append((language, *(each * (x + n * y + z) for x, y, z in zip(*counts)), each * (a + n * b + c), each))
    rows += [(language, *counts, len(corpus.ROOT_FILES[name]), 1) for language, (name, counts) in _ROOT_COUNTS.items()]
    values = ", ".join(str(r) for r in rows)
    sums_sql = ", ".join(f"CAST(sum({c}) AS BIGINT) as {c}" for c in (*loc.SUMS, "files"))
    return f"with t(language, {', '.join(loc.SUMS)}, files) as (values {values}) select language, {sums_sql} from t group by rollup (language)"


def sample_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.statistics(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


QUERIES: dict[str, Query] = {
    "benchmark_corpus": benchmark_corpus,
    "sample_statistics": sample_statistics,
    "loc_by_language": loc_by_language,
    "loc_rollup_totals": loc_rollup_totals,
    "loc_report_totals": loc_report_totals,
    "loc_html_pages": loc_html_pages,
    "ignore_filter": ignore_filter,
    "language_lookup": language_lookup,
    "registry_table": registry_table,
    "dominant_languages": dominant_languages,
    "selection_rank": selection_rank,
    "budget_prefix": budget_prefix,
    "group_summary": group_summary,
    "diff_semi": diff_semi,
    "head_excerpt": head_excerpt,
    "graph_edges": graph_edges,
    "graph_edge_counts": graph_edge_counts,
    "graph_degrees": _degrees,
    "graph_top10": graph_top10,
    "graph_subset": graph_subset,
    "graph_reachable_d": lambda s, d: _reach(s, d, 2, False),
    "reverse_impact": lambda s, d: _reach(s, d, None, True),
    "focus_union": focus_union,
    "java_suffix_resolve": java_suffix_resolve,
}

ORACLES: dict[str, str] = {
    "benchmark_corpus": _corpus_sql(corpus.DATASETS["medium"]),
    "sample_statistics": "select l_returnflag, count(l_quantity) as samples, min(l_quantity) as lowest, avg(l_quantity) as mean, median(l_quantity) as median, max(l_quantity) as highest from lineitem group by l_returnflag",
    "loc_by_language": _LOC_SQL + f" select language, {_SUMS_SQL} from counts group by language",
    "loc_rollup_totals": _LOC_SQL + f" select language, {_SUMS_SQL}, count(*) as files from counts group by rollup (language)",
    "loc_report_totals": _LOC_SQL + f" select {_SUMS_SQL}, count(*) as files_scanned, count(distinct language) as languages_detected from counts",
    "loc_html_pages": _HTML_SQL,
    "ignore_filter": _IGNORE_SQL,
    "language_lookup": _LOOKUP_SQL,
    "registry_table": _REGISTRY_SQL,
    "dominant_languages": _DOMINANT_SQL,
    "selection_rank": _RANK_SQL,
    "budget_prefix": _BUDGET_SQL,
    "group_summary": _GROUP_SQL,
    "diff_semi": _DIFF_SQL,
    "head_excerpt": _HEAD_SQL,
    "graph_edges": f"with {_EDGES_SQL.strip()} select * from edges",
    "graph_edge_counts": f"with {_EDGES_SQL.strip()} select count(*) filter (where resolved) as internal_edges, count(*) filter (where not resolved) as external_edges from edges",
    "graph_degrees": f"with {_DEGREES_SQL} select * from degrees",
    "graph_top10": f"with {_DEGREES_SQL} select path, imported_by_count as count from degrees where imported_by_count > 0 order by 2 desc, 1 limit 10",
    "graph_subset": _SUBSET_SQL,
    "graph_reachable_d": _reach_sql(2, False),
    "reverse_impact": _reach_sql(None, True),
    "focus_union": f"select distinct path from ({_reach_sql(1, False)}) union select distinct path from ({_reach_sql(1, True)})",
    "java_suffix_resolve": _JAVA_SQL,
}

QUERIES |= code_queries.QUERIES
ORACLES |= code_queries.oracles(_CLASS_SQL, _PATH_SQL)
