"""Line counts as a terminal table."""

from __future__ import annotations

from ..operators.loc import SUMS
from ..plans.loc import LocReport

_HEAD = ("Language", "Code", "Comment", "Empty", "Size (bytes)")


def elapsed(seconds: float) -> str:
    """In the largest unit that gives a whole part, and in seconds."""
    for unit, scale in (("s", 1), ("ms", 1e3), ("us", 1e6)):
        if seconds * scale >= 1:
            return f"{seconds * scale:.3f} {unit} ({seconds:.6f} s)"
    return f"{seconds * 1e9:.0f} ns ({seconds:.6f} s)"


def box(rows: list[tuple[str, ...]]) -> str:
    """Rows in a frame with round corners, the first as the head; numbers to the right."""
    width = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    rule = lambda a, fill, b, c: a + b.join(fill * (w + 2) for w in width) + c
    line = lambda r: "│" + "┆".join(f" {x.ljust(w) if not k else x.rjust(w)} " for k, (x, w) in enumerate(zip(r, width))) + "│"
    return "\n".join([rule("╭", "─", "┬", "╮"), line(rows[0]), rule("╞", "═", "╪", "╡"), *map(line, rows[1:]), rule("╰", "─", "┴", "╯")])


def table(r: LocReport) -> str:
    rows = [_HEAD, *[(x["language"], *[str(x[c]) for c in SUMS]) for x in [*r.by_language, {"language": "Totals"} | r.totals]]]
    return f"Scanning: {r.base_path}\n\n{box(rows)}\nFiles scanned: {r.files_scanned}\nLanguages detected: {r.languages_detected}\nElapsed: {elapsed(r.elapsed)}\n"


def plain(r: LocReport) -> str:
    """A line for each language, for tools that read text."""
    line = lambda name, x: f"{name}: " + ", ".join(f"{c}={x[c]}" for c in SUMS)
    return "\n".join([f"base_path: {r.base_path}", *[line(x["language"], x) for x in r.by_language], line("Totals", r.totals), f"files_scanned: {r.files_scanned}", f"languages_detected: {r.languages_detected}"]) + "\n"
