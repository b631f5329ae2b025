import re
import time

import pytest
from pyspark.sql import functions as F

from lignum.functions import lines
from lignum.operators import excerpts, select
from lignum.plans import context
from tests_helpers import files


def test_long_lines_are_sought_from_line_begins(spark):
    texts = ["", "a" * 5, "a" * 6, "\n" + "a" * 6, "ab\r" + "a" * 5 + "\n", "b\r\n" + "a" * 7, "aaa\naaa\naaa", "\n\n"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.long for r in rows.select("k", lines.has_long_line(F.col("t"), 5).alias("long")).collect()}
    assert got == {k: bool(re.search(r"[^\r\n]{6}", t)) for k, t in enumerate(texts)}
    # of lines just below the limit, a search at each place takes as many steps as the square of their length
    took = []
    for length in (9, 9, 1999):
        text = F.concat(F.col("id").cast("string"), F.repeat(F.concat(F.repeat(F.lit("x"), length), F.lit("\n")), 32_000 // (length + 1)))
        began = time.perf_counter()
        assert spark.range(4000, numPartitions=4).filter(lines.has_long_line(text, 2020)).count() == 0
        took.append(time.perf_counter() - began)
    assert took[2] < 8 * took[1]


def tree():
    return {"a.py": "x = 1\n" * 9, "b.bin": "\0", "c.bin": "told\n", "target/d.py": "y = 2\n", "e.py": "\0\n", "f.py": "z" * 3000, "g.py": "", "h.py": "w = 3\n"}


@pytest.mark.parametrize("mode", ["none", "signatures"])
def test_contents_are_read_once_and_where_needed(spark, mode):
    seen = spark.sparkContext.accumulator(0)
    rows = files(spark, tree())

    @F.udf("binary")
    def read(path, content):
        seen.add(1)
        return content

    watched = rows.select("path", "size_bytes", read("path", "content").alias("content"))
    slim = {r.path: (r.is_text, r.least) for r in excerpts.measured(watched, [select.Focus("h.py", False)], mode=mode).collect()}
    assert seen.value == 4  # a.py, e.py, f.py, h.py
    assert slim.keys() == tree().keys() and {p for p, (text, _) in slim.items() if text} == {"a.py", "h.py"}


@pytest.mark.parametrize("diff", [None, ["c.bin", "target/d.py", "b.bin"]])
def test_pack_of_measured_files(spark, diff):
    changed = diff and spark.createDataFrame([(p,) for p in diff], "path string")
    rows, focus = files(spark, tree()), [select.Focus("h.py", False)]
    got = context.report(rows, 4000, focus, changed)
    plain = select.candidates(select.considered(rows, focus, changed))
    assert [f["relative_path"] for f in got.files] == [r["path"] for r in excerpts.fill_budget(plain, 3600)] == ["h.py", *(["c.bin", "target/d.py"] if diff else []), "a.py"]
    assert got.metadata["files_considered"] == (8 if diff else 7)
