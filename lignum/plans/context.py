"""Context packs: the files that matter most, as excerpts that fit a budget of tokens."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.tokens import metadata_estimate, split_budget
from ..operators import excerpts, select
from ..sources import config as C
from ..sources import git, tree


@dataclass
class ContextReport:
    metadata: dict[str, Any]
    dominant_languages: list[dict]
    groups: list[dict]
    files: list[dict]

    def in_group(self, group: str) -> list[dict]:
        return [f for f in self.files if f["group"] == group]

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def groups_of(files: list[dict]) -> list[dict]:
    """Counts of each group that has files, in the order in which groups are shown."""
    out = []
    for group, label in select.GROUPS.items():
        if own := [f for f in files if f["group"] == group]:
            out.append({"group": group, "label": label, "files": len(own), "estimated_tokens": sum(f["estimated_tokens"] for f in own), "truncated_files": sum(f["truncated"] for f in own)})
    return out


def _shown(row: dict) -> dict:
    excerpt = {k: row[k] for k in ("line_start", "line_end", "content")}
    return {"relative_path": row["path"], "language": row["language"], "size_bytes": row["size_bytes"], "estimated_tokens": row["tokens"], "truncated": row["truncated"], "compressed": row["compressed"], "group": row["group"], "selection_class": row["class"], "excerpt": excerpt}


def report(files: DataFrame, budget: int = C.DEFAULT_BUDGET, focuses: Sequence[select.Focus] = (), changed: DataFrame | None = None, mode: str = "none", base_path: str = ".", diff: dict[str, Any] | None = None, extended: bool = False) -> ContextReport:
    """A pack of a table of files (path, size_bytes, content)."""
    kept = select.considered(excerpts.measured(files, focuses, changed is not None, mode, extended), focuses, changed)
    languages = [r.asDict() for r in select.dominant_languages(kept).collect()]  # a row for each known language at most
    metadata_tokens, excerpt_tokens = split_budget(budget)
    chosen = excerpts.fill_budget(select.candidates(kept), excerpt_tokens, mode, extended, files)
    shown = [_shown(r) for r in chosen]
    used = sum(f["estimated_tokens"] for f in shown)
    around = metadata_estimate(len(languages), len(shown), len(set(focuses)), metadata_tokens)
    metadata: dict[str, Any] = {"base_path": base_path, "focus_paths": [f.path or "." for f in sorted(set(focuses))]}
    if diff is not None:
        metadata["diff"] = diff | {"changed_files_selected": sum(bool(r["changed"]) for r in chosen)}
    metadata |= {
        "compression_mode": mode, "budget_tokens": budget, "metadata_budget_tokens": metadata_tokens, "excerpt_budget_tokens": excerpt_tokens,
        "estimated_tokens": used + around, "estimated_metadata_tokens": around, "estimated_excerpt_tokens": used,
        "files_considered": kept.select("path").count(), "files_selected": len(shown), "truncated_files": sum(f["truncated"] for f in shown),
    }
    return ContextReport(metadata, languages, groups_of(shown), shown)


def build(spark: SparkSession, source: git.Source, settings: C.Context) -> ContextReport:
    """A pack of a folder or checkout."""
    files = tree.files(spark, source.path, settings.ignore)
    found = git.changes(source, settings.diff) if settings.diff is not None else None
    diff = None
    if found is not None:
        diff = {"spec": found.spec, "repo_root": source.shown_root or str(found.root), "changed_files_detected": found.detected, "changed_files_in_scope": found.in_scope, "skipped_deleted_or_missing": found.missing}
    changed = git.changed_table(spark, found.paths) if found is not None else None
    return report(files, settings.budget or C.DEFAULT_BUDGET, tree.focuses(source.path, settings.focus), changed, settings.compress or "none", source.shown or str(source.path), diff)
