import json
import random

import pytest
from pyspark.sql import functions as F

from lignum.functions import tokens
from lignum.functions.lines import lines
from lignum.operators import excerpts, select
from lignum.plans import context
from lignum.render import context as render

FILES = "path string, size_bytes long, content binary"


def files(spark, rows):
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], FILES)


def test_budgets():
    assert [tokens.parse_budget(x) for x in ("128000", "128k", "2M", 7)] == [128_000, 128_000, 2_000_000, 7]
    for bad in ("", "0", "-1", "1.5k", "k", "1g", "9" * 20, "10000000000000m"):
        with pytest.raises(ValueError):
            tokens.parse_budget(bad)
    assert tokens.split_budget(101) == (11, 90) and tokens.split_budget(1) == (1, 0)
    assert [tokens.estimate_of(n) for n in (0, 1, 4, 5)] == [1, 1, 1, 2]
    assert tokens.metadata_estimate(2, 3, 1, 10_000) == 128 + 32 + 72 + 16 and tokens.metadata_estimate(2, 3, 1, 9) == 9


def test_estimate_column(spark):
    assert [r[0] for r in spark.range(10).select(tokens.estimate(F.col("id"))).collect()] == [tokens.estimate_of(n) for n in range(10)]


def test_lines_column(spark):
    cases = {"": [], "\n": [""], "a\r\nb\rc\n\rd": ["a", "b", "c", "", "d"], "a\n\n": ["a", ""], "x": ["x"]}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", lines(F.col("t")).alias("l")).collect()
    assert {r.t: r.l for r in got} == cases


def test_full_and_head_excerpts():
    e = excerpts.excerpt(b"\xef\xbb\xbfa\r\nb\n", 8, False, 100)
    assert (e.content, e.line_start, e.line_end, e.tokens, e.truncated) == ("a\nb", 1, 2, 1, False)
    long = b"line\n" * 1000
    e = excerpts.excerpt(long, len(long), False, 10_000)
    assert (e.line_end, e.truncated, e.content.count("\n")) == (120, True, 119)
    assert excerpts.excerpt(long, len(long), True, 10_000).line_end == 240
    e = excerpts.head_excerpt("é".encode() * 100, 10, 3)
    assert (e.content, e.truncated, e.line_end) == ("é" * 6, True, 1)
    e = excerpts.head_excerpt(b"\n\nabc\nd", 10, 100)  # leading blank lines are counted, not shown
    assert (e.content, e.line_end, e.truncated) == ("abc\nd", 4, False)
    e = excerpts.head_excerpt(b"\n\n", 10, 100)
    assert (e.content, e.line_end, e.tokens) == ("", 2, 1)
    assert excerpts.excerpt(b"\xff\xfe", 2, False, 10).content == "\ufffd\ufffd"
    wide = b"x" * 9000
    e = excerpts.excerpt(wide, 9000, False, 5000)
    assert e.tokens == 2000 and e.truncated


def walk(rows, budget):
    """The walk over all candidates in rank order."""
    out, used, partial = [], 0, False
    for path, data, focused in rows:
        left = budget - used
        cap = excerpts.TOKENS[focused]
        if left <= 0 or partial or (left < -(-cap // 4) and tokens.estimate_of(len(data)) > left):
            break
        e = excerpts.excerpt(data, len(data), focused, left)
        used, partial = used + e.tokens, e.truncated and left < cap
        out.append((path, e.tokens, e.truncated, e.content))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_budget_equals_walk_over_all(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["src/{}.py", "tests/{}.py", "{}/README.md", "{}/main.rs"]).format(k), b"\n" * rng.choice([0, 0, 300]) + b"word word\n" * rng.choice([1, 5, 60, 500, 2000])) for k in range(40)]
    kept = select.candidates(select.considered(files(spark, rows), [select.Focus(rows[0][0], False)]))
    order = [r.path for r in kept.orderBy(select.order()).collect()]
    data = dict(rows)
    for budget in (1, 40, 600, 5000, 30_000):
        want = walk([(p, data[p], p == rows[0][0]) for p in order], budget)
        got = excerpts.fill_budget(kept, budget)
        assert [(r["path"], r["tokens"], r["truncated"], r["content"]) for r in got] == want
        frontier = {r.path for r in excerpts.budget_frontier(kept, budget, excerpts._least_cost("none", False)).collect()}
        assert {p for p, *_ in want} <= frontier


def test_report_and_renderings(spark):
    rows = [("README.md", b"# hi\n"), ("src/main.rs", b"fn main() {}\n"), ("src/a.py", b"x = 1\n" * 2000), ("dist/skip.py", b"1\n"), (".github/workflows/ci.yml", b"on: push\n"), ("tests/t.py", b"assert 1\n"), ("src/f.py", b"focus\n"), ("ch.py", b"changed\n"), ("bin.dat", b"\0")]
    changed = spark.createDataFrame([("ch.py",)], "path string")
    r = context.report(files(spark, rows), 4000, [select.Focus("src/f.py", False)], changed, diff={"spec": "main", "repo_root": "/r", "changed_files_detected": 1, "changed_files_in_scope": 1, "skipped_deleted_or_missing": 0})
    assert [g["group"] for g in r.groups] == ["focus", "changes", "entrypoints", "testing", "project-metadata", "workflows", "general"]
    assert [f["relative_path"] for f in r.files] == ["src/f.py", "ch.py", "README.md", ".github/workflows/ci.yml", "src/main.rs", "tests/t.py", "src/a.py"]
    m = r.metadata
    assert (m["files_considered"], m["files_selected"], m["truncated_files"], m["diff"]["changed_files_selected"]) == (8, 7, 1, 1)
    assert (m["metadata_budget_tokens"], m["excerpt_budget_tokens"]) == (400, 3600)
    assert m["estimated_excerpt_tokens"] == sum(f["estimated_tokens"] for f in r.files) == sum(g["estimated_tokens"] for g in r.groups)
    assert r.dominant_languages[0]["language"] == "Python" and [f["relative_path"] for f in r.in_group("general")] == ["src/a.py"]
    text = render.markdown(r)
    assert "| Diff spec | `main` |" in text and "````rs\nfn main() {}\n````" in text and "| Changes | 1 |" in text
    assert json.loads(render.to_json(r))["files"][0]["excerpt"] == {"line_start": 1, "line_end": 1, "content": "focus"}
    none = context.report(files(spark, []), 100)
    assert none.files == [] and "No file fits" in render.markdown(none) and "No known languages" in render.markdown(none)


def test_compressed_pack(spark):
    body = b"def f(a):\n    return a\n\nclass C:\n    x = 1\n"
    r = context.report(files(spark, [("a.py", body), ("b.md", b"text\n")]), 1000, mode="signatures")
    by = {f["relative_path"]: f for f in r.files}
    assert by["a.py"]["compressed"] and by["a.py"]["excerpt"]["content"] == "def f(a): { … }\n\nclass C: { … }" and not by["b.md"]["compressed"]
