"""The reachability queries against a plain search over every resolved import."""

import pytest

from lignum import queries

ROWS = [  # order, line, supplier, part, quantity: s/ files import p/ files in even orders, p/ files s/ files in odd ones
    (2, 1, 1, 1, 5), (2, 2, 1, 2, 5), (2, 3, 1, 7, 5), (4, 1, 2, 1, 5), (4, 2, 2, 3, 5), (4, 3, 3, 4, 5), (6, 1, 4, 9, 5), (6, 2, 5, 5, 50),
    (3, 1, 1, 1, 5), (3, 2, 2, 2, 5), (3, 3, 1, 3, 5), (3, 4, 3, 7, 5), (5, 1, 4, 3, 5), (5, 2, 5, 4, 5), (5, 3, 1, 5, 5), (5, 4, 2, 9, 5), (7, 1, 1, 1, 5),
    (8, 1, 0, 9, 5), (9, 1, 0, 8, 5), (9, 2, 1, 8, 5),  # p/8.py imports a dead end before s/1.py
]


def search(depth, reverse):
    """{path: distance}"""
    files = {f"s/{s}.py" if o % 2 == 0 else f"p/{p}.py" for o, _, s, p, _ in ROWS}
    known = {f for f in files if not (f.startswith("p/") and f.endswith("9.py"))}
    pairs = set()
    for o, _, s, p, quantity in ROWS:
        a, b = (f"s/{s}.py", f"p/{p}.py") if o % 2 == 0 else (f"p/{p}.py", f"s/{s}.py")
        if quantity <= 45 and b in known:
            pairs.add((b, a) if reverse else (a, b))
    seen, now, step = {"s/1.py": 0}, {"s/1.py"}, 0
    while now and (depth is None or step <= depth):
        step += 1
        now = {b for a, b in pairs if a in now} - set(seen)
        seen |= dict.fromkeys(now, step)
    return seen


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("reach")
    rows = spark.createDataFrame([(o, n, s, p, float(q)) for o, n, s, p, q in ROWS], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double")
    rows.write.parquet(f"{at}/lineitem.parquet")
    return str(at)


@pytest.mark.parametrize(("name", "depth", "reverse"), [("graph_reachable_d", 2, False), ("reverse_impact", None, True)])
def test_all_imports_count(spark, sf_dir, name, depth, reverse):
    assert {r.path: r.distance for r in queries.QUERIES[name](spark, sf_dir).collect()} == search(depth, reverse)


def test_both_ways(spark, sf_dir):
    assert {r.path for r in queries.QUERIES["focus_union"](spark, sf_dir).collect()} == set(search(1, False)) | set(search(1, True))
