"""Context packs as Markdown or JSON."""

from __future__ import annotations

import json

from ..plans.context import ContextReport

_DIFF = {"spec": "Diff spec", "repo_root": "Diff repo root", "changed_files_detected": "Changed files detected", "changed_files_in_scope": "Changed files in scope", "changed_files_selected": "Changed files selected", "skipped_deleted_or_missing": "Skipped deleted or missing"}
_FIELDS = {
    "budget_tokens": "Budget tokens", "metadata_budget_tokens": "Metadata budget tokens", "excerpt_budget_tokens": "Excerpt budget tokens",
    "estimated_tokens": "Estimated total tokens", "estimated_metadata_tokens": "Estimated metadata tokens", "estimated_excerpt_tokens": "Estimated excerpt tokens",
    "files_considered": "Files considered", "files_selected": "Files selected", "truncated_files": "Truncated files",
}


def grid(head: list[str], rows: list[list[object]], numbers: int) -> list[str]:
    """A Markdown table; `numbers` has the columns that are aligned right, as bits."""
    rule = ["---:" if numbers >> k & 1 else "---" for k in range(len(head))]
    return ["| " + " | ".join(map(str, r)) + " |" for r in [head, rule, *rows]]


def _fence(path: str) -> str:
    stem, dot, ext = path.rpartition("/")[2].rpartition(".")
    return ext.lower() if dot and stem else ""


def _code(x: object) -> str:
    return f"`{x}`"


def _excerpt(f: dict, label: str) -> list[str]:
    e = f["excerpt"]
    facts = {"Group": label, "Language": f["language"] or "unknown", "Reason": f["selection_class"], "Size": f"{f['size_bytes']} bytes", "Estimated tokens": f["estimated_tokens"], "Truncated": "yes" if f["truncated"] else "no", "Lines": f"{e['line_start']}-{e['line_end']}"}
    ticks = "`" * 4
    return ["", f"### File: {_code(f['relative_path'])}", *[f"- {k}: {v}" for k, v in facts.items()], "", ticks + _fence(f["relative_path"]), e["content"], ticks]


def markdown(r: ContextReport) -> str:
    m = r.metadata
    facts: list[list[object]] = [["Base path", _code(m["base_path"])], ["Focus paths", ", ".join(map(_code, m["focus_paths"])) or "none"]]
    if "diff" in m:
        facts += [[label, _code(m["diff"][k]) if k in ("spec", "repo_root") else m["diff"][k]] for k, label in _DIFF.items()]
    facts += [[label, m[k]] for k, label in _FIELDS.items()]
    out = ["# Context Pack", "", "## Metadata", *grid(["Field", "Value"], facts, 0), "", "## Dominant Languages"]
    if r.dominant_languages:
        out += grid(["Language", "Files", "Size (bytes)"], [[x["language"], x["files"], x["size_bytes"]] for x in r.dominant_languages], 6)
    else:
        out.append("No known languages.")
    out += ["", "## File Groups"]
    if r.groups:
        out += grid(["Group", "Files", "Tokens", "Truncated"], [[g["label"], g["files"], g["estimated_tokens"], g["truncated_files"]] for g in r.groups], 14)
    else:
        out.append("No file fits the budget.")
    for g in r.groups:
        files = r.in_group(g["group"])
        out += ["", f"## {g['label']}", f"_{g['files']} files, {g['estimated_tokens']} estimated tokens, {g['truncated_files']} truncated_", ""]
        out += grid(["Path", "Language", "Reason", "Size (bytes)", "Tokens", "Truncated"], [[_code(f["relative_path"]), f["language"] or "unknown", f["selection_class"], f["size_bytes"], f["estimated_tokens"], "yes" if f["truncated"] else "no"] for f in files], 24)
        for f in files:
            out += _excerpt(f, g["label"])
    return "\n".join(out) + "\n"


def to_json(r: ContextReport) -> str:
    return json.dumps(r.as_dict(), indent=2, ensure_ascii=False)


FORMATS = {"markdown": markdown, "json": to_json}


def profiles(path: object, names: list[str]) -> str:
    if path is None:
        return "No `.lignum.toml` file found for the selected path."
    return f"Config: {path}\n" + ("Profiles:\n" + "\n".join(names) if names else "No context profiles defined.")


def profiles_json(path: object, names: list[str]) -> str:
    return json.dumps({"source_path": None if path is None else str(path), "profiles": names}, indent=2, ensure_ascii=False)
