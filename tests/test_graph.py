import json
import random
import xml.dom.minidom

import pytest

from lignum.operators import graph
from lignum.plans import graph as plan
from lignum.render import graph as render
from tests_helpers import files

TREE = {
    "src/main.rs": "use crate::a;\nuse crate::b::c;\nuse std::io;\n",
    "src/a.rs": "use crate::b::c;\nuse crate::b::c;\n",
    "src/b/c.rs": "use super::super::x;\nuse crate::a;\n",
    "py/app.py": "from . import util\nimport os\n",
    "py/__init__.py": "",
    "web/i.ts": "import x from './j';\n",
    "web/j.js": "export * from './i';\nrequire('./j')\n",
    "c/m.c": '#include "h.h"\n#include <stdio.h>\n',
    "c/h.h": "int x;",
    "J.java": "import com.x.K;\n",
    "lib/com/x/K.java": "class K {}",
    "notes.md": "import nothing",
}


@pytest.fixture(scope="module")
def whole(spark):
    return plan.report(plan.select(files(spark, TREE)), "base")


def edges(r):
    return [(e["from"], e["to"], e["import_path"]) for e in r.edges]


def test_edges_nodes_and_metrics(whole):
    assert ("src/main.rs", "src/b/c.rs", "crate::b::c") in edges(whole) and ("c/m.c", "c/h.h", "h.h") in edges(whole)
    assert ("src/main.rs", None, "std::io") in edges(whole) and ("J.java", "lib/com/x/K.java", "com.x.K") in edges(whole)
    by = {n["file_path"]: n for n in whole.nodes}
    assert list(by) == sorted(by) and "notes.md" not in by
    assert by["c/h.h"] == {"file_path": "c/h.h", "language": None, "imports_count": 0, "imported_by_count": 1}
    assert by["src/a.rs"]["imports_count"] == 2 and by["src/b/c.rs"]["imported_by_count"] == 3  # each import counts
    m = whole.metrics
    assert m["total_internal_edges"] + m["total_external_edges"] == len(whole.edges) and m["total_files"] == len(by)
    assert m["most_imported"][0] == {"file_path": "src/b/c.rs", "count": 3}
    assert ["src/a.rs", "src/b/c.rs", "src/a.rs"] in m["cycles"] and ["web/j.js", "web/j.js"] in m["cycles"] and m["circular_dependencies"] == len(m["cycles"]) == 3


def test_selection(spark):
    rows = files(spark, TREE)
    near = plan.report(plan.select(rows, ["src/main.rs"], 0))
    assert [n["file_path"] for n in near.nodes] == ["src/a.rs", "src/b/c.rs", "src/main.rs"] and near.depth == 0
    assert ("src/main.rs", None, "std::io") in edges(near)
    assert [n["file_path"] for n in plan.report(plan.select(rows, ["py"])).nodes] == ["py/__init__.py", "py/app.py"]
    asked = plan.report(plan.select(rows, depends_on="src/a.rs"))
    assert [n["file_path"] for n in asked.nodes] == ["src/a.rs", "src/b/c.rs", "src/main.rs"] and asked.query == {"depends_on": "src/a.rs"}
    both = plan.report(plan.select(rows, ["web"], None, "c/h.h"))
    assert [n["file_path"] for n in both.nodes] == ["c/h.h", "c/m.c", "web/i.ts", "web/j.js"]
    assert plan.report(plan.select(rows, ["nothing"])).nodes == []
    with pytest.raises(ValueError, match="no file"):
        plan.select(rows, depends_on="notes.md")


def test_targets(tmp_path):
    assert plan.target(tmp_path, "./a/../b.py") == "b.py" and plan.target(tmp_path, str(tmp_path.resolve() / "x/y.py")) == "x/y.py" and plan.target(tmp_path, "a\\b") == "a/b"
    for bad in ("../x", "a/../../x", "/elsewhere/x"):
        with pytest.raises(ValueError):
            plan.target(tmp_path, bad)


def links(spark, pairs):
    return spark.createDataFrame([(a, k, b, 1, b, True) for k, (a, b) in enumerate(pairs)], "from string, ord long, import_path string, line long, to string, resolved boolean")


@pytest.mark.parametrize("seed", range(3))
def test_reachability_equals_search(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(35)]
    roots = spark.createDataFrame([("n0",), ("n1",), ("n0",)], "path string")
    for reverse in (False, True):
        for depth in (0, 1, None):
            want, now, step = {"n0": 0, "n1": 0}, {"n0", "n1"}, 0
            while now and (depth is None or step <= depth):
                step += 1
                now = {y for a, b in pairs for x, y in [(b, a) if reverse else (a, b)] if x in now} - set(want)
                want |= dict.fromkeys(now, step)
            assert {r.path: r.distance for r in graph.reachable(roots, links(spark, pairs), depth, reverse).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_pruning_keeps_the_cycles(spark, seed):
    rng = random.Random(seed)
    pairs = sorted((f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(16))
    assert graph.cycles(links(spark, pairs)) == graph.find_cycles(pairs)


def test_cycles():
    assert graph.find_cycles([]) == []
    assert graph.find_cycles([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]) == [["a", "b", "c", "a"]]
    assert graph.find_cycles([("a", "a"), ("a", "a")]) == [["a", "a"]]
    assert graph.find_cycles([("a", "b"), ("b", "a"), ("b", "b")]) == [["a", "b", "a"], ["b", "b"]]
    assert graph.find_cycles([(f"n{k:05}", f"n{k + 1:05}") for k in range(50_000)]) == []


def test_renderings(whole):
    assert json.loads(render.to_json(whole))["metrics"]["total_files"] == len(whole.nodes)
    text = render.markdown(whole)
    assert "| Internal edges |" in text and "graph LR" in text and "`src/a.rs` → `src/b/c.rs` → `src/a.rs`" in text
    doc = xml.dom.minidom.parseString(render.xml(whole))
    assert len(doc.getElementsByTagName("nodes")[0].getElementsByTagName("node")) == len(whole.nodes) and any(e.getAttribute("to") == "(unresolved)" for e in doc.getElementsByTagName("edge"))
    assert [[n.firstChild.data for n in c.getElementsByTagName("node")] for c in doc.getElementsByTagName("cycle")] == whole.metrics["cycles"] and not doc.getElementsByTagName("selection")
    assert '"src_main_rs" -> "src_a_rs";' in render.dot(whole) and "std" not in render.dot(whole)
    many = plan.GraphReport("x", ["<f&>"], 2, {"depends_on": 'a"b'}, [{"file_path": "a", "language": None, "imports_count": 60, "imported_by_count": 60}], [{"from": "a", "to": "a", "import_path": "a", "resolved": True}] * 60, {"total_files": 1, "total_internal_edges": 60, "total_external_edges": 0, "circular_dependencies": 0, "most_importing": [], "most_imported": [], "cycles": []})
    assert "%% ... and 10 more edges" in render.markdown(many) and render.markdown(many).count("n0 --> n0") == 50
    assert xml.dom.minidom.parseString(render.xml(many)).getElementsByTagName("query")[0].firstChild.data == 'depends_on:a"b'


def test_empty(spark):
    r = plan.report(plan.select(files(spark, {})))
    assert r.nodes == [] and r.edges == [] and "Diagram" not in render.markdown(r)
