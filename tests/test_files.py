import subprocess

import pytest
from pyspark.sql import functions as F

from lignum.operators import ignore, select
from lignum.sources import config, git, tree


@pytest.fixture
def folder(tmp_path):
    for path, text in {"src/main.rs": "fn main() {}\n", "src/lib/util.py": "x = 1\n", ".github/workflows/ci.yml": "on: push\n", "node_modules/m/index.js": "1\n", "README.md": "hi\n", "_u/x.py": "", "target/debug/out.py": "y\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "link.py").symlink_to(tmp_path / "README.md")
    return tmp_path


def test_listing(folder):
    assert [p for p, _, _ in tree.listed(folder)] == sorted([".github/workflows/ci.yml", "README.md", "_u/x.py", "node_modules/m/index.js", "src/lib/util.py", "src/main.rs", "target/debug/out.py"])
    assert [p for p, _, _ in tree.listed(folder, ignore.Ignore(["*.py", "^node_modules$", "workflows"]))] == ["README.md", "src/main.rs"]
    with pytest.raises(FileNotFoundError):
        tree.listed(folder / "gone")
    with pytest.raises(NotADirectoryError):
        tree.listed(folder / "README.md")


def test_contents(spark, folder):
    got = {r.path: bytes(r.content) for r in tree.files(spark, folder, ["target"]).collect()}
    assert got["src/main.rs"] == b"fn main() {}\n" and got["_u/x.py"] == b"" and len(got) == 6
    assert "ArrowEvalPython" not in tree.files(spark, folder).select("path")._jdf.queryExecution().executedPlan().toString()
    (folder / "empty").mkdir()
    assert tree.files(spark, folder / "empty").collect() == []


def test_ignore_patterns(spark):
    paths = ["a/b.py", "b.pyc", "target/x.rs", "src/target.rs", "x/[y].txt", "d/e/f.md", "A.PY", "a\\c.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for patterns in (["*.py"], ["target/"], ["^target"], ["?.py*"], ["[ab].*"], ["[!a-c].*"], ["*.{py,md}"], ["e/f"], [], ["*.py", "rs$"], ["**"]):
        kept = {r.path for r in ignore.keep(df, patterns).collect()}
        matcher = ignore.Ignore(patterns)
        want = {p for p in paths if not any(matcher.matches("/".join(p.replace("\\", "/").split("/")[: n + 1])) for n in range(p.replace("\\", "/").count("/") + 1))}
        assert kept == want, patterns
    for broken in ("[a", "(", "*{a"):
        with pytest.raises(ValueError, match="to ignore"):
            ignore.Ignore([broken])


def test_focus(folder):
    assert tree.focuses(folder, ["src", folder / "src/main.rs", "src"]) == [select.Focus("src", True), select.Focus("src/main.rs", False)]
    assert tree.focuses(folder, ["."]) == [select.Focus("", True)]
    with pytest.raises(FileNotFoundError):
        tree.focuses(folder, ["gone"])
    with pytest.raises(ValueError):
        tree.focuses(folder / "src", [folder / "README.md"])


def test_classes(spark):
    cases = {
        "src/main.rs": "entrypoint", "lib.py": "entrypoint", "a/mod.rs": "entrypoint", "README": "manifest", "docs/readme.txt": "manifest", "x/Cargo.toml": "manifest", ".gitignore": "manifest", "license-mit": "manifest",
        ".github/workflows/a.yml": "workflow", "x/.github/workflows/a.yml": "general", "tests/main.rs": "entrypoint", "a/tests/x.py": "adjacent-test", "benches/b.rs": "adjacent-test", "test/x.py": "general",
        "focus/dir/a.py": "focused-descendant", "focus/file.py": "focused-file", "focus/dir2/a.py": "general", "new.py": "diff-file", "focus/dir/new.py": "focused-descendant",
    }
    df = spark.createDataFrame([(p, 10, w) for p, w in cases.items()] + [("dist/a.py", 10, "dropped"), ("a/dist/b.py", 10, "general")], "path string, size_bytes long, want string")
    changed = spark.createDataFrame([("new.py",), ("new.py",), ("focus/dir/new.py",), ("gone.py",)], "path string")
    got = select.considered(df, [select.Focus("focus/dir", True), select.Focus("focus/file.py", False)], changed)
    assert [tuple(r) for r in got.filter("class <> want").select("path", "class").collect()] == [] and got.count() == len(cases) + 1


def test_a_focused_folder_goes_before_its_files(spark):
    df = spark.createDataFrame([("a/b.py",)], "path string")
    both = [select.Focus("a/b.py", False), select.Focus("a", True)]
    assert df.select(select.focus_class(F.col("path"), both)).first()[0] == "focused-descendant"


def test_candidates(spark):
    long, wide = b"x" * 2001, b"\n".join([b"x" * 2000] * 40)
    rows = [("a.py", b"ok"), ("b.py", b""), ("c.py", b"\0bin"), ("d.js", long), ("e.js", wide), ("f.xyz", b"unknown"), ("LICENSE", b"text"), (".github/workflows/run", b"x"), ("g.py", b"x\n" * 20_000 + b"\0")]
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, size_bytes long, content binary")
    kept = [r.path for r in select.candidates(select.considered(df)).orderBy(select.order()).collect()]
    assert kept == ["LICENSE", ".github/workflows/run", "a.py", "g.py", "e.js"]
    huge = spark.createDataFrame([("a.py", (1 << 20) + 1), ("b.py", 1 << 20)], "path string, size_bytes long")
    assert [r.path for r in select.candidates(select.considered(huge)).collect()] == ["b.py"]


def _git(folder, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@localhost", "-c", "init.defaultBranch=main", "-c", "commit.gpgsign=false", *args], cwd=folder, check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "work"
    (root / "sub").mkdir(parents=True)
    for n in "abcd":
        (root / f"sub/{n}.py").write_text(f"{n} = 1\n" * 5)
    (root / "top.py").write_text("t = 1\n")
    for args in (["init"], ["add", "."], ["commit", "-m", "one"], ["checkout", "-b", "feature/x"]):
        _git(root, *args)
    (root / "sub/a.py").write_text("a = 2\n")
    _git(root, "mv", "sub/b.py", "sub/moved.py")
    _git(root, "commit", "-am", "two")
    return root


def test_changes(repo):
    at = git.Source(repo / "sub", repo)
    c = git.changes(at, "main")
    assert (c.paths, c.detected, c.in_scope, c.missing) == (["a.py", "moved.py"], 2, 2, 0)
    (repo / "sub/c.py").write_text("c = 2\n")
    _git(repo, "add", "sub/c.py")
    (repo / "sub/d.py").unlink()
    (repo / "new.py").write_text("")
    assert git.changes(at, "staged").paths == ["c.py"]
    u = git.changes(at, "unstaged")
    assert (u.paths, u.detected, u.in_scope, u.missing) == ([], 2, 1, 1)
    w = git.changes(at, " working-tree ")
    assert (w.paths, w.detected, w.in_scope, w.missing) == (["c.py"], 3, 2, 1)
    for bad in ("", "no-such-ref"):
        with pytest.raises((ValueError, git.GitError)):
            git.changes(at, bad)


def test_checkouts(repo):
    url = f"file://{repo}"
    s = git.resolve(url=url, ref="feature/x")
    assert s.is_remote and (s.path / "sub/moved.py").is_file() and s.shown == f"{url}@feature/x"
    assert (git.resolve(url=url, ref="main").path / "sub/b.py").is_file()
    with pytest.raises(ValueError):
        git.changes(s, "staged")
    for bad in ({"path": ".", "url": url}, {"ref": "main"}, {"path": ".", "ref": "x"}):
        with pytest.raises(ValueError):
            git.resolve(**bad)
    with pytest.raises(git.GitError):
        git.resolve(url=url, ref="nothing")


def test_urls():
    p = git.parse_url
    assert p("git@host:team/repo.git") == git.Remote("git@host:team/repo.git", "git@host:team/repo")
    assert p("https://h.example/t/r.git") == git.Remote("https://h.example/t/r.git", "https://h.example/t/r")
    assert p("https://h.example:8/t/r/tree/a/b/c") == git.Remote("https://h.example:8/t/r", "https://h.example:8/t/r", "/tree/", ["a", "b", "c"])
    assert p("https://h.example/g/s/r/-/tree/main") == git.Remote("https://h.example/g/s/r", "https://h.example/g/s/r", "/-/tree/", ["main"])
    for bad in ("", "ftp://h/a/b", "https://h/one", "https://h/t/r/blob/main/x", "https://h/t/r/tree", "https://h/t/r/-/tree/", "words"):
        with pytest.raises(ValueError):
            p(bad)


def test_name_status():
    assert git.name_status(b"M\0a\0R100\0old\0new\0D\0gone\0C75\0x\0y\0") == ["a", "new", "gone", "y"] and git.name_status(b"") == []
    with pytest.raises(git.GitError):
        git.name_status(b"R100\0old\0")


def test_settings(tmp_path):
    inner = tmp_path / "a/b"
    inner.mkdir(parents=True)
    (tmp_path / config.FILE_NAME).write_text('[context]\nignore=["x"]\nfocus=["src"]\nbudget="2k"\nformat="json"\n[profiles.review.context]\nignore=["y"]\ndiff="main"\nbudget=500\n[profiles.z]\n')
    c = config.find(inner)
    assert list(c.profiles) == ["review", "z"]
    m = config.merge(config.Context(ignore=["z"], compress="skeleton"), c, "review")
    assert (m.ignore, m.budget, m.diff, m.format, m.compress, m.focus) == (["x", "y", "z"], 500, "main", "json", "skeleton", [str(tmp_path.resolve() / "src")])
    plain = config.merge(config.Context())
    assert (plain.budget, plain.format, plain.diff) == (128_000, "markdown", None)
    assert config.find(inner, disabled=True) is None
    with pytest.raises(ValueError, match="review, z"):
        config.merge(config.Context(), c, "nope")
    with pytest.raises(FileNotFoundError):
        config.find(inner, tmp_path / "none.toml")
    for bad in ("[other]", "[context]\nwhat=1", '[context]\nbudget="x"', "[context]\nbudget=0", '[context]\ncompress="all"', '[context]\nformat="xml"', "[context]\nignore=1", "not toml", "[context]\nbudget=true", "[profiles.p]\nx=1"):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(ValueError, match="bad.toml"):
            config.load(tmp_path / "bad.toml")
    assert config.rebased("/co/repo/out/x.md", tmp_path.__class__("/co/repo"), tmp_path) == str(tmp_path / "out/x.md")
