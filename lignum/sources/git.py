"""Repositories as sources: clones of URLs, refs, and the files that changed."""

from __future__ import annotations

import subprocess
import tempfile
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


class GitError(RuntimeError):
    """What git said when it failed."""


def git(folder: str | Path | None, *args: str) -> bytes:
    done = subprocess.run(["git", *args], cwd=folder, capture_output=True)
    if done.returncode:
        said = done.stderr.decode("utf-8", "replace").strip() or done.stdout.decode("utf-8", "replace").strip()
        raise GitError(f"git {args[0]} failed: {said}")
    return done.stdout


def git_line(folder: str | Path, *args: str) -> str:
    return git(folder, *args).decode("utf-8", "replace").strip()


@dataclass
class Remote:
    """What a URL names. tail: the segments after 'tree', a ref that may hold slashes and a path in it."""

    clone_url: str
    shown: str
    marker: str | None = None
    tail: list[str] = field(default_factory=list)


def parse_url(raw: str) -> Remote:
    url = raw.strip()
    if not url:
        raise ValueError("the URL is empty")
    if "://" not in url and "@" in url.partition(":")[0] and ":" in url:
        return Remote(url, url.removesuffix(".git"))
    parts = urlsplit(url)
    if parts.scheme in ("ssh", "file"):
        return Remote(url.rstrip("/"), url.rstrip("/").removesuffix(".git"))
    if parts.scheme not in ("http", "https"):
        raise ValueError(f"a URL of this kind can't be read: {url}" if parts.scheme else f"not a URL: {url}")
    path = [x for x in parts.path.split("/") if x]
    if len(path) < 2:
        raise ValueError("the URL names no repository")
    port = f":{parts.port}" if parts.port else ""
    root = lambda n: f"{parts.scheme}://{parts.hostname}{port}/{'/'.join(path[:n])}"
    if path[2:3] == ["blob"]:
        raise ValueError("URLs of single files (blob) can't be read")
    dash = path.index("-") if "-" in path else -1
    if dash >= 0 and path[dash + 1 : dash + 2] == ["tree"]:
        if dash < 2:
            raise ValueError("the URL names no repository")
        at, marker, repo = dash + 2, "/-/tree/", dash
    elif path[2:3] == ["tree"]:
        at, marker, repo = 3, "/tree/", 2
    else:
        if "blob" in path:
            raise ValueError("URLs of single files (blob) can't be read")
        return Remote(url.rstrip("/"), url.rstrip("/").removesuffix(".git"))
    if not path[at:]:
        raise ValueError("the tree URL has no ref")
    return Remote(root(repo), root(repo), marker, path[at:])


@dataclass
class Source:
    """A folder to analyse, the repository around it, and how to show them if they are a checkout."""

    path: Path
    root: Path
    shown: str | None = None
    shown_root: str | None = None
    guard: tempfile.TemporaryDirectory[str] | None = None

    def display(self, path: Path) -> str:
        """A path of the checkout as one of the repository that was cloned; any other as it is."""
        root = self.root.resolve()
        if self.shown_root is None or not path.resolve().is_relative_to(root):
            return str(path)
        inside = path.resolve().relative_to(root).as_posix()
        return self.shown_root if inside == "." else f"{self.shown_root}/{inside}"

    @property
    def is_remote(self) -> bool:
        return self.guard is not None


def _commit(repo: Path, ref: str) -> str:
    return git_line(repo, "rev-parse", "--verify", "--end-of-options", ref + "^{commit}")


def check_out(repo: Path, ref: str) -> str:
    """Check out a ref, or the remote branch of that name."""
    ref = ref.strip()
    if not ref:
        raise ValueError("the ref is empty")
    try:
        commit = _commit(repo, ref)
    except GitError:
        commit = _commit(repo, f"origin/{ref}")
    git(repo, "checkout", "--detach", commit)
    return ref


def resolve(path: str | Path | None = None, url: str | None = None, ref: str | None = None, checkouts: str | Path | None = None) -> Source:
    """The source that a path, or a URL and perhaps a ref, stands for; the working folder without either.

    Clones go below `checkouts`, which executors must reach too; a temporary folder is for one machine only.
    """
    if path is not None and url is not None:
        raise ValueError("give a path or a URL, not both")
    if url is None:
        if ref is not None:
            raise ValueError("a ref needs a URL")
        where = Path(path if path is not None else ".")
        return Source(where, where)
    remote = parse_url(url)
    if remote.tail and ref is not None:
        raise ValueError("a tree URL has its own ref")
    guard = tempfile.TemporaryDirectory(prefix="lignum-checkout-", dir=checkouts)
    repo = Path(guard.name) / "repo"
    git(None, "clone", "--quiet", "--", remote.clone_url, str(repo))
    inside, shown = "", remote.shown
    shown_root = shown
    if remote.tail:
        for n in range(len(remote.tail), 0, -1):
            try:
                found = check_out(repo, "/".join(remote.tail[:n]))
            except GitError:
                continue
            inside = "/".join(remote.tail[n:])
            shown_root, shown = f"{remote.shown}@{found}", f"{remote.shown}{remote.marker}{found}" + (f"/{inside}" if inside else "")
            break
        else:
            raise GitError(f"no ref is at the start of {'/'.join(remote.tail)}")
    elif ref is not None:
        shown = shown_root = f"{shown}@{check_out(repo, ref)}"
    target = (repo / inside).resolve()
    if not target.is_dir() or target != repo.resolve() and repo.resolve() not in target.parents:
        raise NotADirectoryError(f"the checkout has no folder {inside}")
    return Source(repo / inside, repo, shown, shown_root, guard)


def name_status(out: bytes) -> list[str]:
    """Paths of `git diff --name-status -z`; the new one of renames and copies."""
    words = out.decode("utf-8", "surrogateescape").removesuffix("\0").split("\0")
    paths, at = [], 0
    while at < len(words) and words[at]:
        n = 2 if words[at][0] in "RC" else 1
        if at + n >= len(words):
            raise GitError("git's list of changes is cut off")
        paths.append(words[at + n])
        at += n + 1
    return paths


@dataclass
class Changes:
    spec: str
    root: Path
    paths: list[str]
    detected: int
    in_scope: int
    missing: int


def changes(source: Source, spec: str) -> Changes:
    """Changed files below the analysed folder: of 'working-tree', 'staged', 'unstaged', or since a base ref."""
    spec = spec.strip()
    if not spec:
        raise ValueError("the diff is empty")
    local = spec in ("working-tree", "staged", "unstaged")
    if local and source.is_remote:
        raise ValueError(f"a checkout of a URL has no {spec} changes; give a base ref")
    base = source.path.resolve()
    root = Path(git_line(base, "rev-parse", "--show-toplevel")).resolve()
    status = lambda *more: name_status(git(root, "diff", *more, "--name-status", "-z", "--find-renames"))
    found: set[str] = set()
    if spec in ("working-tree", "staged"):
        found.update(status("--cached"))
    if spec in ("working-tree", "unstaged"):
        found.update(status())
        found.update(p for p in git(root, "ls-files", "--others", "--exclude-standard", "-z").decode("utf-8", "surrogateescape").split("\0") if p)
    if not local:
        fork = git_line(root, "merge-base", "--end-of-options", spec, "HEAD")
        found.update(name_status(git(root, "diff", "--name-status", "-z", "--find-renames", fork, "HEAD")))
    scope = base.relative_to(root).as_posix()
    prefix = "" if scope == "." else scope + "/"
    inside = sorted(p for p in found if p.startswith(prefix))
    there = [p for p in inside if (root / p).is_file()]
    return Changes(spec, root, [p[len(prefix) :] for p in there], len(found), len(inside), len(inside) - len(there))


def changed_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p.replace("\\", "/") or ".",) for p in paths], "path string")
