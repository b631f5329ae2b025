"""Excerpts of files, and the files that fit a token budget.

Filling a budget is a walk in rank order whose steps depend on each other. The
parallel part leaves it little to do: each candidate gets a lower bound of its
cost, a running sum of these (bucket sums first, so no task sees all files)
keeps the candidates whose predecessors cost less than the budget, a superset
of the answer that is bounded by the budget because each costs a token at
least, and only these have their contents collected for the exact walk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import lines as L
from ..functions import paths
from ..functions.arrow import in_pieces
from ..functions.tokens import ceil_div, estimate, estimate_of
from . import compress, select
from .graph import written
from .loc import split_lines

FULL_BYTES = 4096
#: of an exactly focused file, or of any other: most lines and most tokens
LINES, TOKENS = {True: 240, False: 120}, {True: 4000, False: 2000}


@dataclass
class Excerpt:
    line_start: int
    line_end: int
    content: str
    tokens: int
    truncated: bool
    compressed: bool = False


def full_excerpt(data: bytes) -> Excerpt:
    rows = [x.decode("utf-8", "replace") for x in split_lines(data)]
    text = "\n".join(rows)
    return Excerpt(1, len(rows), text, estimate_of(len(text.encode())), False)


def head_excerpt(data: bytes, lines: int, tokens: int) -> Excerpt:
    """The first lines that fit; a first line that doesn't is clipped between characters. Leading blank lines are counted, not shown."""
    room = 4 * tokens
    rows = split_lines(data)
    text, end, size = "", 0, 0
    shown: list[str] = []
    for k, raw in enumerate(rows[:lines]):
        line = raw.decode("utf-8", "replace")
        n = len(line.encode())
        if size + (size > 0) + n > room:
            if not size:
                shown, end = [line.encode()[:room].decode("utf-8", "ignore")], k + 1
            break
        if size or n:
            shown.append(line)
            size += (size > 0) + n
        end = k + 1
    else:
        text = "\n".join(shown)
        return Excerpt(1, end, text, estimate_of(len(text.encode())), end < len(rows))
    text = "\n".join(shown)
    return Excerpt(1, end, text, estimate_of(len(text.encode())), True)


def excerpt(data: bytes, size_bytes: int, focused: bool, allowed: int, language: str | None = None, mode: str = "none", extended: bool = False) -> Excerpt:
    """What a pack shows of a file when `allowed` tokens are left. A compressed excerpt isn't cut to them."""
    body = data[3:] if data[:3] == b"\xef\xbb\xbf" else data
    if mode != "none" and (syntax := compress.syntax_of(language, extended)):
        out = compress.compress(data.decode("utf-8", "replace"), syntax, mode)
        if out.items:
            return Excerpt(1, max(1, len(out.content.splitlines())), out.content, estimate_of(len(out.content.encode())), False, True)
    limit = min(TOKENS[focused], allowed)
    if size_bytes <= FULL_BYTES and estimate_of(len(body)) <= limit:
        return full_excerpt(body)
    return head_excerpt(body, LINES[focused], limit)


def heads(content: Column, lines: int, tokens: int) -> Column:
    """`head_excerpt` of each file: content, line_end and truncated."""

    @F.arrow_udf(_HEAD)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            found = [None if c is None else head_excerpt(c, lines, tokens) for c in contents.to_pylist()]
            yield pa.array([e and {"content": e.content, "line_end": e.line_end, "truncated": e.truncated} for e in found], pa.struct([("content", pa.string()), ("line_end", pa.int64()), ("truncated", pa.bool_())]))

    return run(content)


_HEAD = T.StructType([T.StructField("content", T.StringType()), T.StructField("line_end", T.LongType()), T.StructField("truncated", T.BooleanType())])
_LEAST = T.LongType()


def _least_native() -> Column:
    """`_least_cost` without compression, in the JVM: of a small file its bytes, of another its first lines, or the limit less a line."""
    text = L.unix(L.as_latin(F.coalesce("content", F.lit(b""))))
    focused = F.col("class") == "focused-file"
    pick = lambda limits: F.when(focused, limits[True]).otherwise(limits[False])
    # a line end fewer than it may have, and a mark of byte order
    head = lambda t: F.greatest(F.lit(0), F.length(F.ltrim(t, F.lit("\n"))) - 4)
    first = F.least(head(F.when(focused, F.substring_index(text, "\n", LINES[True])).otherwise(F.substring_index(text, "\n", LINES[False]))), 4 * pick(TOKENS) - 3 * select.LINE_BYTES - 1)  # bytes that are no UTF-8 count three
    return estimate(F.when(F.col("size_bytes") <= FULL_BYTES, F.least(head(text), first)).otherwise(first))


def _least_cost(mode: str, extended: bool) -> Column:
    """No less than what the walk charges a file that isn't its last."""

    def of(content: bytes | None, focused: bool, language: str | None) -> int:
        c = content or b""
        whole = excerpt(c, len(c), focused, TOKENS[focused], language, mode, extended)
        return whole.tokens if whole.compressed else min(whole.tokens, head_excerpt(c, LINES[focused], TOKENS[focused]).tokens)

    @F.arrow_udf(_LEAST)
    def least(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from in_pieces(batches, of, pa.int64())

    return _least_native() if mode == "none" else least.asNondeterministic()(F.col("content"), F.col("class") == "focused-file", F.col("language"))


def measured(files: DataFrame, focuses: Sequence[select.Focus] = (), changes: bool = False, mode: str = "none", extended: bool = False) -> DataFrame:
    """(path, size_bytes, is_text, least) of files (path, size_bytes, content): all that choosing needs of the contents, which are read once.

    Written, so that what follows moves and sorts rows without contents. Those
    of files that can't be shown aren't read; with changes, any path may be.
    """
    path = F.col("path")
    may = F.coalesce(select.can_show(F.lit(changes)) & select.is_considered(focuses, F.lit(changes)), F.lit(False))
    focus = F.coalesce(select.focus_class(path, focuses), F.lit(""))  # whether a file is focused follows from its path
    shown = files.filter(may).withColumns({"class": focus, "language": paths.language(path)})
    costs = shown.select("path", "size_bytes", F.coalesce(select.is_text(F.col("content")), F.lit(False)).alias("is_text"), _least_cost(mode, extended).alias("least"))
    rest = files.filter(~may).select("path", "size_bytes", F.lit(False).alias("is_text"), F.lit(0).cast("bigint").alias("least"))
    return written(costs.unionByName(rest), "measured")


def prior_cost(rows: DataFrame, cost: Column) -> DataFrame:
    """rows with `prior`, the cost of all rows that rank before.

    Two levels: sums by (class, range of sizes) come first, so the running sum
    inside them is spread over tasks. The windows sort what `rows` has, so it
    should have no contents.
    """
    with_cost = rows.withColumns({"cost": cost, "rank": select.rank_of(F.col("class")), "range": select.size_range()})
    sums = with_cost.groupBy("rank", "range").agg(F.sum("cost").alias("t"))
    before = Window.orderBy("rank", "range").rowsBetween(Window.unboundedPreceding, -1)  # at most 8 classes of 64 * 256 ranges
    bases = sums.select("rank", "range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "range").orderBy("size_bytes", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = with_cost.join(F.broadcast(bases), ["rank", "range"])
    return placed.withColumn("prior", F.col("base") + F.coalesce(F.sum("cost").over(inside), F.lit(0))).drop("base", "range", "cost", "rank")


def budget_frontier(candidates: DataFrame, tokens: int, cost: Column | None = None) -> DataFrame:
    """Candidates whose predecessors cost less than `tokens`; cost defaults to the estimate of the size.

    Only paths and sizes are sorted; contents join the few that are left. A
    path is a row of its own.
    """
    slim = candidates.select("path", "size_bytes", "class", (estimate(F.col("size_bytes")) if cost is None else cost).alias("least"))
    near = prior_cost(slim, F.col("least")).filter(F.col("prior") < tokens).select("path", "prior")
    return candidates.join(near, "path")


def fill_budget(candidates: DataFrame, tokens: int, mode: str = "none", extended: bool = False, contents: DataFrame | None = None) -> list[dict]:
    """The files of a pack, in rank order, as rows with their excerpt; contents (path, content) if candidates are of `measured` files.

    The few that can be in it are written before contents join, so that Spark
    knows how few they are.
    """
    least = _least_cost(mode, extended) if contents is None else F.col("least")
    slim = candidates.select("path", "size_bytes", "language", "class", "changed", least.alias("least"))
    near = written(prior_cost(slim, F.col("least")).filter(F.col("prior") < tokens).withColumn("rank", select.rank_of(F.col("class"))), "near")
    rows = (candidates if contents is None else contents).select("path", "content").join(near, "path")
    chosen: list[dict] = []
    used, partial = 0, False
    for r in rows.orderBy("rank", "size_bytes", "path").toLocalIterator():  # as many as tokens at most; read while they are needed
        left = tokens - used
        focused = r["class"] == "focused-file"
        if left <= 0 or partial or (left < ceil_div(TOKENS[focused], 4) and estimate_of(r.size_bytes) > left):
            break
        e = excerpt(bytes(r.content), r.size_bytes, focused, left, r.language, mode, extended)
        used += e.tokens
        partial = e.truncated and left < TOKENS[focused]
        chosen.append({"path": r.path, "language": r.language, "size_bytes": r.size_bytes, "class": r["class"], "group": select.CLASSES[r["class"]][1], "changed": r.changed} | asdict(e))
    return chosen
