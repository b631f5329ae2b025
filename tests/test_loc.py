import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lignum.operators import loc
from lignum.plans import loc as plan
from lignum.registry import LANGUAGES, STYLES, Style
from lignum.streaming import loc as stream

C, JULIA, NONE = STYLES["c"], STYLES["julia"], Style(None, None, None)
FILES = "path string, size_bytes long, content binary"


def by_bytes(data, style):
    """Straight from the definition, a byte at a time."""
    single, start, end = (t.encode() if t else None for t in style)
    totals, depth = [0, 0, 0], 0
    for line in loc.split_lines(data):
        code = comment = False
        k = 0
        while k < len(line):
            at = line[k:]
            if depth:
                if end and at.startswith(end):
                    depth, comment, k = depth - 1, True, k + len(end)
                elif start != end and at.startswith(start):
                    depth, comment, k = depth + 1, True, k + len(start)
                else:
                    comment, k = comment or line[k] not in b" \t\n\f\r", k + 1
                continue
            if line[k] in b" \t\n\f\r":
                k += 1
                continue
            multi = start is not None and at.startswith(start)
            if single and at.startswith(single) and not (multi and len(start) >= len(single)):
                comment = True
                break
            if multi:
                depth, comment, k = 1, True, k + len(start)
                continue
            code, k = True, k + 1
        totals[0 if code else 1 if comment else 2] += 1
    return tuple(totals)


@pytest.mark.parametrize(
    ("text", "style", "want"),
    [
        ("", C, (0, 0, 0)),
        ("/* comment */\n", C, (0, 1, 0)),
        ("let value = 1; /* comment */\n", C, (1, 0, 0)),
        ("/* comment\n*/ let value = 1;\n", C, (1, 1, 0)),
        ("/* outer\n/* inner */\nclosing */\nlet value = 1;\n", C, (1, 3, 0)),
        ("{\r\n\r\n}\r\nfinal", NONE, (3, 0, 1)),
        ("/*\n   \n*/\n", C, (0, 2, 1)),
        ("#=\ncomment\n=#\nvalue\n", JULIA, (1, 3, 0)),
        ("alpha\rbeta\r\rgamma", NONE, (3, 0, 1)),
        ("alpha\r\nbeta\ngamma\r\rdelta", NONE, (4, 0, 1)),
        ("// comment\rvalue\r/* block */\r", C, (1, 2, 0)),
        ("/* outer\r\ninner\rclosing */\nlet value = 1;\r// comment", C, (1, 4, 0)),
        ("value\r", NONE, (1, 0, 0)),
        ("\x0b\n", NONE, (1, 0, 0)),
        ('"/*" x\n', C, (1, 0, 0)),
        ("*/*\n", C, (1, 0, 0)),
    ],
)
def test_counts(text, style, want):
    assert loc.count_lines(text.encode(), style) == want


@pytest.mark.parametrize("name", sorted(STYLES))
def test_every_style_and_line_end(name):
    rng = random.Random(name)
    style = STYLES[name]
    pieces = [" ", "\t", "x", "val = 1", "\x0b", "é", *(t for t in style if t), *(t[:1] for t in style if t)]
    for _ in range(60):
        text = "".join(rng.choice(pieces) if rng.random() < 0.75 else rng.choice(["\n", "\r\n", "\r"]) for _ in range(40))
        assert loc.count_lines(text.encode(), style) == by_bytes(text.encode(), style), (name, text)


def test_tables_agree_with_the_scanner(spark):
    rng = random.Random(1)
    rows = []
    for k, (name, x) in enumerate(LANGUAGES.items()):
        style = STYLES[x.style]
        pieces = [b" ", b"\t\f", b"x = 1", b"\x85\xff", b"\x0b", *(t.encode() for t in style if t)]
        data = b"".join(rng.choice(pieces) if rng.random() < 0.7 else rng.choice([b"\n", b"\r\n", b"\r"]) for _ in range(120))
        rows.append((f"d/{k}." + x.extensions[0] if x.extensions else "d/" + x.names[0], len(data), bytearray(data)))
    want = {p: by_bytes(bytes(d), STYLES[LANGUAGES[n].style]) for (p, _, d), n in zip(rows, LANGUAGES)}
    got = loc.with_counts(spark.createDataFrame([*rows, ("x.unknown", 1, bytearray(b"x"))], FILES)).collect()
    assert {r.path: (r.code_lines, r.comment_lines, r.empty_lines) for r in got} == want


@given(st.binary(max_size=60))
def test_any_bytes(data):
    assert sum(loc.count_lines(data, C)) == len(loc.split_lines(data))


def test_report(spark):
    rows = [("a.py", 4, bytearray(b"x\n#y")), ("b.py", 2, bytearray(b"\n\n")), ("c.rs", 0, bytearray(b"")), ("d.md", 1, bytearray(b"x")), ("e.json", 1, bytearray(b"y")), ("f.zzz", 9, bytearray(b"not known"))]
    r = plan.report(spark.createDataFrame(rows, FILES))
    assert [x["language"] for x in r.by_language] == ["Python", "JSON", "Markdown"]
    assert (r.files_scanned, r.languages_detected) == (5, 3) and r.totals == {"code_lines": 3, "comment_lines": 1, "empty_lines": 2, "size_bytes": 8}
    none = plan.report(spark.createDataFrame([], FILES))
    assert none.by_language == [] and none.files_scanned == 0 and none.totals["code_lines"] == 0
    assert loc.totals(loc.with_counts(spark.createDataFrame([], FILES))).collect()[0].files_scanned == 0


def test_stream_equals_batch(spark, tmp_path):
    files = spark.createDataFrame([("a.py", 4, bytearray(b"x\n#y")), ("b.c", 8, bytearray(b"/*\n*/\nx;"))], FILES)
    files.write.parquet(str(tmp_path / "in"))
    stream.count_into(stream.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, loc.with_counts(files).collect()))


def test_native_counts_skip_python(spark):
    plan_text = loc.by_language(loc.with_counts(spark.createDataFrame([("a.md", 1, bytearray(b"x"))], FILES)))._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("ArrowEvalPython") == 1
