"""Settings of context packs: a TOML file with a [context] table and profiles, merged with what the caller gives."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from ..functions.tokens import parse_budget
from ..operators.compress import MODES

FILE_NAME = ".lignum.toml"
FORMATS = ("markdown", "json")
DEFAULT_BUDGET = 128_000
_LISTS, _TEXTS = ("ignore", "focus"), ("diff", "compress", "format", "output")


@dataclass
class Context:
    """None and empty: not given."""

    ignore: list[str] = field(default_factory=list)
    focus: list[str] = field(default_factory=list)
    diff: str | None = None
    budget: int | None = None
    compress: str | None = None
    format: str | None = None
    output: str | None = None


@dataclass
class Config:
    path: Path
    context: Context
    profiles: dict[str, Context]


def _checked(value: str | None, known: tuple[str, ...], what: str) -> str | None:
    if value is not None and value not in known:
        raise ValueError(f"unknown {what} {value!r}; one of {', '.join(known)}")
    return value


def checked(c: Context) -> Context:
    _checked(c.compress, MODES, "compression")
    _checked(c.format, FORMATS, "format")
    return c


def _only(table: Any, names: tuple[str, ...], where: str) -> dict[str, Any]:
    if not isinstance(table, dict):
        raise ValueError(f"{where} must be a table")
    if more := sorted(set(table) - set(names)):
        raise ValueError(f"{where} has the unknown key {more[0]!r}")
    return table


def _section(table: Any, where: str, folder: Path) -> Context:
    t = _only(table, (*_LISTS, *_TEXTS, "budget"), where)
    for k in _LISTS:
        if not isinstance(t.get(k, []), list) or not all(isinstance(x, str) for x in t.get(k, [])):
            raise ValueError(f"{where}.{k} must be a list of strings")
    for k in _TEXTS:
        if not isinstance(t.get(k, ""), str):
            raise ValueError(f"{where}.{k} must be a string")
    budget = t.get("budget")
    if budget is not None and (isinstance(budget, bool) or not isinstance(budget, int | str)):
        raise ValueError(f"{where}.budget must be a number or a string like '128k'")
    out = t.get("output")
    try:
        return checked(Context(list(t.get("ignore", [])), [str(folder / f) for f in t.get("focus", [])], t.get("diff"), None if budget is None else parse_budget(budget), t.get("compress"), t.get("format"), None if out is None else str(folder / out)))
    except ValueError as e:
        raise ValueError(f"{where}: {e}") from e


def load(path: str | Path) -> Config:
    """ValueError says which key of which table is wrong. Paths are from the file's folder."""
    path = Path(path)
    try:
        data = tomllib.loads(path.read_text())
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{path} is no TOML: {e}") from e
    try:
        top = _only(data, ("context", "profiles"), "the file")
        folder = path.resolve().parent
        profiles = {n: _section(_only(p, ("context",), f"profiles.{n}").get("context", {}), f"profiles.{n}.context", folder) for n, p in sorted(_only(top.get("profiles", {}), tuple(top.get("profiles", {})), "profiles").items())}
        return Config(path, _section(top.get("context", {}), "context", folder), profiles)
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e


def discover(base: str | Path) -> Path | None:
    """The nearest settings file, from the base folder upwards."""
    at = Path(base).resolve()
    return next((f / FILE_NAME for f in (at, *at.parents) if (f / FILE_NAME).is_file()), None)


def find(base: str | Path, path: str | Path | None = None, disabled: bool = False) -> Config | None:
    if disabled:
        if path is not None:
            raise ValueError("settings can't be both named and switched off")
        return None
    where = Path(path) if path is not None else discover(base)
    if where is None:
        return None
    if not where.is_file():
        raise FileNotFoundError(f"no such settings file: {where}")
    return load(where)


def merge(given: Context, config: Config | None = None, profile: str | None = None) -> Context:
    """Lists add up: file, profile, caller. Of single values the caller's goes first, then the profile's, then the file's."""
    layers = [given]
    if profile is not None:
        if config is None:
            raise ValueError(f"profile {profile!r} needs a settings file")
        if profile not in config.profiles:
            raise ValueError(f"no profile {profile!r}; there are: {', '.join(config.profiles) or 'none'}")
        layers.append(config.profiles[profile])
    if config is not None:
        layers.append(config.context)
    first = {k: next((v for c in layers if (v := getattr(c, k)) is not None), None) for k in (*_TEXTS, "budget")}
    lists = {k: [x for c in reversed(layers) for x in getattr(c, k)] for k in _LISTS}
    out = Context(**lists, **first)
    return checked(replace(out, budget=out.budget or DEFAULT_BUDGET, format=out.format or "markdown"))


def rebased(output: str, checkout: Path, working: Path) -> str:
    """An output path inside a checkout, moved to the working folder."""
    full = Path(output).resolve()
    root = checkout.resolve()
    return str(working / full.relative_to(root)) if root in full.parents else output
