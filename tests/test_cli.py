import json

import pytest

from lignum import cli
from lignum.render import loc as render


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.py").write_text("import b\n# note\n\n")
    (tmp_path / "b.py").write_text("def f():\n    return 1\n")
    (tmp_path / "README.md").write_text("text\n")
    return tmp_path


def test_loc(spark, folder, capsys):
    assert cli.main(["loc", "--path", str(folder), "--ignore", "*.md"], spark) == 0
    out = capsys.readouterr().out
    assert "│ Python   ┆    3 ┆       1 ┆     1 ┆" in out and "Files scanned: 2" in out and "Markdown" not in out


def test_context(spark, folder, capsys):
    to = folder / "out/deep/pack.json"
    assert cli.main(["context", "--path", str(folder), "--format", "json", "--budget", "1k", "--compress", "signatures", "--focus", "b.py", "--output", str(to)], spark) == 0
    pack = json.loads(to.read_text())
    assert pack["files"][0]["selection_class"] == "focused-file" and pack["metadata"]["budget_tokens"] == 1000
    (folder / ".lignum.toml").write_text('[profiles.small.context]\nbudget=10\n')
    assert cli.main(["context", "--path", str(folder), "--list-profiles"], spark) == 0 and "Profiles:\nsmall\n" in capsys.readouterr().out
    assert cli.main(["context", "--path", str(folder), "--profile", "small"], spark) == 0 and "| Budget tokens | 10 |" in capsys.readouterr().out


def test_graph(spark, folder, capsys):
    assert cli.main(["graph", "--path", str(folder), "--what-depends-on", "b.py"], spark) == 0
    assert [n["file_path"] for n in json.loads(capsys.readouterr().out)["nodes"]] == ["a.py", "b.py"]


def test_errors(spark, folder, capsys):
    for args in (["loc", "--path", str(folder / "none")], ["loc", "--ref", "x"], ["loc", "--path", str(folder), "--ignore", "("], ["graph", "--path", str(folder), "--what-depends-on", "z.py"], ["graph", "--path", str(folder), "--depth", "-1"], ["context", "--path", str(folder), "--profile", "p"], ["context", "--path", str(folder), "--focus", "none"]):
        assert cli.main(args, spark) == 1 and capsys.readouterr().err.startswith("error: ")


def test_elapsed():
    assert [render.elapsed(x).split(" (")[0] for x in (2.5, 0.0039, 4.2e-5, 3e-8)] == ["2.500 s", "3.900 ms", "42.000 us", "30 ns"]
    assert render.elapsed(0.003909) == "3.909 ms (0.003909 s)"
