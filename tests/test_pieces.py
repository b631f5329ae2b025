import pyarrow as pa
import pytest

from lignum import code_queries
from lignum.functions import arrow
from lignum.operators import compress, graph, masking
from tests_helpers import files


def python_steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_imports_are_read_once(spark):
    tree = {f"p/m{k}.py": f"import p.m{k + 1}\n# text\n" for k in range(600)} | {"no.md": "import x\n", "p/none.py": "x = 1\n"}
    found = graph.extracted(graph.analysed(files(spark, tree)))
    assert python_steps(found) == 1
    rows = found.collect()
    assert len(rows) == 600 and {(r["from"], r.import_path) for r in rows} == {(f"p/m{k}.py", f"p.m{k + 1}") for k in range(600)}


def test_pieces_are_bounded():
    rows = [b"x" * n for n in (1, 3 << 20, 2 << 20, 5 << 20, *[2] * 600)] + [None]
    got = list(arrow.in_pieces(iter([(pa.array(rows),), (pa.array([], pa.binary()),)]), lambda c: c and len(c), pa.int64()))
    assert [len(p) for p in got] == [3, 1, 256, 256, 89]
    assert pa.concat_arrays(got).to_pylist() == [c and len(c) for c in rows]


def test_compression_reads_once(spark):
    assert python_steps(code_queries.compressed_sources(spark, "/root/testdata/sf0.001")) == 1


@pytest.mark.parametrize("syntax", sorted(masking._STRINGS))
def test_modes_together(syntax):
    source = "import a\n\n/* one\ntwo */\nclass A:\n  x = 1\n\nif (x) { y(); }\nfunction f() { return 1; }\nconst q =\n\n  // told\n  1\n# end\n" * 3
    modes = ("skeleton", "none", "signatures")
    assert compress.compress_all(source, syntax, modes) == [compress.compress(source, syntax, m) for m in modes]


def test_places_mask_as_the_whole():
    source = "a = 'x' # b\n'''c\nd''' # é\n"
    assert masking.places(source, "python") == [(4, 7, False), (8, 11, True), (12, 21, False), (22, 25, True)]
    assert masking.mask(source, "python") == "a =        \n    \n        \n" and masking.mask(source, "python", strings=False) == "a = 'x'    \n'''c\nd'''    \n"
