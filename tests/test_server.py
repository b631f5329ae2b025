import io
import json

import pytest

from lignum import server
from lignum.plans import loc
from lignum.sources import corpus


@pytest.fixture
def ask(spark):
    def run(*messages):
        out = io.StringIO()
        server.serve(spark, [m if isinstance(m, str) else json.dumps(m) for m in messages], out)
        return [json.loads(x) for x in out.getvalue().splitlines()]

    return run


def call(name, **arguments):
    return {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": name, "arguments": arguments}}


def test_protocol(ask):
    first, tools, lost, bad, wrong, ping = ask({"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, "", {"id": 2, "method": "tools/list"}, {"id": 3, "method": "none"}, "{", "[]", {"id": 4, "method": "ping"})
    assert first["result"]["capabilities"] == {"tools": {}} and [t["name"] for t in tools["result"]["tools"]] == ["loc", "context", "graph"]
    assert (lost["error"]["code"], bad["error"]["code"], wrong["error"]["code"], ping["result"]) == (-32601, -32700, -32600, {})


def test_tools(ask, tmp_path):
    (tmp_path / "a.py").write_text("import b\n")
    (tmp_path / "b.py").write_text("x = 1\n")
    path = str(tmp_path)
    lines, pack, deps, names = ask(call("loc", path=path), call("context", path=path, format="json", budget="1k"), call("graph", path=path, depends_on="b.py"), call("context", path=path, list_profiles=True))
    text = lambda r: r["result"]["content"][0]["text"]
    assert "Python: code_lines=2, comment_lines=0" in text(lines) and "files_scanned: 2" in text(lines)
    assert len(json.loads(text(pack))["files"]) == 2 and len(json.loads(text(deps))["nodes"]) == 2 and json.loads(text(names)) == {"source_path": None, "profiles": []}
    failed, unknown, tool = ask(call("graph", path=path, format="png"), call("loc", path=path, colour=1), call("sql"))
    assert failed["result"]["isError"] and unknown["error"]["code"] == tool["error"]["code"] == -32602


def test_corpus(spark):
    assert [d.modules * d.files * 7 + 2 for d in corpus.DATASETS.values()][:3] == [65, 282, 898]
    small = loc.report(corpus.files(spark, corpus.DATASETS["small"]))
    assert small.files_scanned == 65 and small.languages_detected == 9
    d = corpus.Dataset(2, 2, 1, 100_000)
    size = lambda n: corpus.files(spark, corpus.Dataset(2, 2, n)).selectExpr("sum(size_bytes)").first()[0]
    assert size(corpus.repeats(d)) >= 100_000 > size(corpus.repeats(d) - 1)
    assert corpus.repeats(corpus.DATASETS["extra-large"]) > 1000
    assert corpus.chosen(None) == list(corpus.DEFAULT) and corpus.chosen(["large", "large"]) == ["large"]
    with pytest.raises(ValueError):
        corpus.chosen(["huge"])


def test_corpus_on_disk(spark, tmp_path):
    (base,) = corpus.write(tmp_path / "trees", ["small"])
    made = {r.path: bytes(r.content) for r in corpus.files(spark, corpus.DATASETS["small"]).collect()}
    assert {p.relative_to(base).as_posix(): p.read_bytes() for p in base.rglob("*") if p.is_file()} == made
    (tmp_path / "trees" / "old").write_text("")
    corpus.write(tmp_path / "trees", ["small"], clean=True)
    assert sorted(p.name for p in (tmp_path / "trees").iterdir()) == ["small"]
