import math
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lignum import queries

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_twins(spark, con, name):
    got = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr([plain(dict(zip(names, r))[c]) for c in got.columns]) for r in found.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in got.collect()) == want and want


def test_entry(spark):
    assert entry.entry(spark).columns == ["language", "code_lines", "comment_lines", "empty_lines", "size_bytes"]
    assert math.isfinite(entry.entry(spark).count())


def test_the_rest_works_without_the_llm_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("lignum.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("lignum.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    import lignum

    monkeypatch.delattr(lignum, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) == set(queries.ORACLES)


def test_nothing_else_imports_the_llm_package():
    root = Path(entry.__file__).parent / "lignum"
    assert [p for p in root.rglob("*.py") if "llm" not in p.parts and ".llm" in p.read_text()] == []
