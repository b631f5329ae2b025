"""The queries that have SQL, against it."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lignum.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents pages conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else None
    if isinstance(x, bytearray):
        return bytes(x)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr([plain(dict(zip(names, r))[c]) for c in got.columns]) for r in found.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in got.collect()) == want and want
