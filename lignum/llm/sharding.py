"""Sharding along a Hilbert curve over several metadata dimensions.

lang, source and n_chars are quantised to `BITS` bits each, and the cell they
give is numbered along a Hilbert curve, so neighbouring cells are alike in all
dimensions at once and a run of them has narrow ranges in each, which is what
lets a reader skip files. Cells are few (2^(3 * BITS), whatever the input), so
their running sum of characters is one small table; a run covers about
`run_chars`. A cell larger than that is cut into several runs by hash of doc_id.
The rows move once, whole, to the partition of their run, and are sorted there;
a task gets one run, or when there are more than `TASKS` runs an even share of
them that are next to each other.

Defined cases: null lang and source are values of their own, sorting first; a
null n_chars counts as 0 and as the lowest level; ties on the curve are in
order of doc_id, nulls first; repeated rows stay, next to each other; with one
value a dimension is constant; an empty table gives no rows; extra columns are
carried along, but for any named curve_index or run_id, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import DOC_COLUMNS, order_hash, order_hash_sql, written

DIMS, BITS = 3, 5
LEVELS = 1 << BITS
#: Lower bounds of the length levels 1, 2, ...: half-octaves from 8 characters.
LENGTHS = [round(8 * 2 ** (k / 2)) for k in range(LEVELS - 1)]
RUN_CHARS = 32_000_000
#: most partitions of a result; beyond that many runs a task writes several
TASKS = 40_000


def curve_tables(n: int = DIMS) -> tuple[list[int], list[int]]:
    """(digit, next state) by state * 2^n + bits, of the n-dimensional Hilbert curve.

    A state is (entry corner e, direction d), as e * n + d.
    """
    mask = (1 << n) - 1
    rol = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & mask
    gray = lambda x: x ^ (x >> 1)
    ones = lambda x: ((x ^ (x + 1)) >> 1).bit_length()
    rank = {gray(w): w for w in range(1 << n)}
    digit, follow = [], []
    for state in range((1 << n) * n):
        e, d = divmod(state, n)
        for bits in range(1 << n):
            w = rank[rol(bits ^ e, n - (d + 1) % n)]
            entry = gray(2 * ((w - 1) // 2)) if w else 0
            step = 0 if not w else ones(w if w % 2 else w - 1) % n
            digit.append(w)
            follow.append((e ^ rol(entry, d + 1)) * n + (d + step + 1) % n)
    return digit, follow


def _level_sql() -> list[str]:
    """SQL of the bits of all dimensions at each level, top first."""
    out = []
    for level in range(BITS - 1, -1, -1):
        out.append(" + ".join(f"((d{k} >> {level}) & 1) * {1 << (DIMS - 1 - k)}" for k in range(DIMS)))
    return out


def shard(docs: DataFrame, run_chars: int = RUN_CHARS) -> DataFrame:
    """The documents with curve_index and run_id, partitioned by run and sorted along the curve."""
    names = [c for c in docs.columns if c not in ("curve_index", "run_id")]
    base = docs.select(F.struct(*names).alias("row"), "doc_id", "lang", "source", "n_chars")

    def ranked(name: str, level: str) -> DataFrame:
        values = base.select(name).distinct()
        n = values.agg(F.count("*").alias("n"))
        rank = F.row_number().over(Window.orderBy(F.col(name).asc_nulls_first())) - 1
        ranks = values.withColumn("r", rank).crossJoin(F.broadcast(n)).select(F.col(name).alias(f"key_{level}"), F.expr(f"cast(r * {LEVELS} div n as int)").alias(level))
        return written(ranks, f"ranks-{name}")  # its size is known then: a few values are broadcast, so the texts don't move for them

    x = base
    for name, level in (("lang", "d0"), ("source", "d1")):
        x = x.join(ranked(name, level), F.col(name).eqNullSafe(F.col(f"key_{level}"))).drop(f"key_{level}")
    x = x.withColumn("d2", F.expr(" + ".join(f"int(coalesce(n_chars, 0) >= {t})" for t in LENGTHS)))
    digit, follow = (f"array({', '.join(map(str, t))})" for t in curve_tables())
    x = x.withColumn("at", F.lit(0)).withColumn("curve_index", F.lit(0))
    for bits in _level_sql():
        x = x.withColumn("at", F.expr(f"at * {1 << DIMS} + {bits}"))
        x = x.withColumn("curve_index", F.expr(f"curve_index * {1 << DIMS} + element_at({digit}, at + 1)")).withColumn("at", F.expr(f"element_at({follow}, at + 1)"))
    x = x.drop("at", "d0", "d1", "d2")
    cells = x.groupBy("curve_index").agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("t"))
    upto = F.sum("t").over(Window.orderBy("curve_index"))  # at most 2^(DIMS * BITS) rows
    cells = cells.withColumn("upto", upto).select("curve_index", F.expr(f"(upto - t) div {run_chars}").alias("first"), F.expr(f"greatest(1, upto div {run_chars} - (upto - t) div {run_chars})").alias("runs"))
    cells = written(cells, "cells")
    runs = cells.agg(F.max(F.expr("first + runs"))).first()[0] or 1
    tasks = min(runs, TASKS)
    placed = x.join(F.broadcast(cells), "curve_index")  # bounded as above
    out = placed.withColumn("run_id", F.col("first") + F.pmod(order_hash(F.col("doc_id"), "shard"), F.col("runs")))
    there = out.select("row", "doc_id", "curve_index", "run_id").repartitionById(tasks, F.expr(f"cast(run_id * {tasks} div {runs} as int)"))
    return there.sortWithinPartitions("run_id", "curve_index", "doc_id").select("row.*", "curve_index", "run_id")


def manifest(sharded: DataFrame) -> DataFrame:
    """What a reader prunes by: for each run the ranges of each dimension."""
    ranges = [f(c).alias(f"{n}_{c}") for c in ("lang", "source", "n_chars") for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("run_id").agg(F.count("*").alias("rows"), F.min("curve_index").alias("min_curve"), F.max("curve_index").alias("max_curve"), *ranges)


def write_runs(sharded: DataFrame, path: str) -> None:
    """A folder for each run."""
    sharded.write.partitionBy("run_id").parquet(path)


def shard_sql(table: str = "documents", run_chars: int = RUN_CHARS) -> str:
    digit, follow = (f"[{', '.join(map(str, t))}]" for t in curve_tables())
    steps, last = [], "q"
    for k, bits in enumerate(_level_sql()):
        steps.append(f"s{k} as (select * replace (state * {1 << DIMS} + {bits} as state) from {last}), h{k} as (select * replace (curve_index * {1 << DIMS} + {digit}[state + 1] as curve_index, {follow}[state + 1] as state) from s{k})")
        last = f"h{k}"
    rank = lambda c: f"(select {c}, CAST((row_number() over (order by {c} nulls first) - 1) * {LEVELS} // (select count(*) from (select distinct {c} from {table})) AS INTEGER) as lev from (select distinct {c} from {table}))"
    length = " + ".join(f"CAST(coalesce(n_chars, 0) >= {t} AS INTEGER)" for t in LENGTHS)
    return f"""
with q as (select {", ".join(f"t.{c}" for c in DOC_COLUMNS)}, a.lev as d0, b.lev as d1, {length} as d2, 0 as state, 0 as curve_index
  from {table} t join {rank("lang")} a on t.lang is not distinct from a.lang join {rank("source")} b on t.source is not distinct from b.source),
{", ".join(steps)},
cells as (select curve_index, sum(coalesce(n_chars, 0)) as t from {last} group by curve_index),
run as (select *, sum(t) over (order by curve_index) as upto from cells),
cut as (select curve_index, (upto - t) // {run_chars} as first, greatest(1, upto // {run_chars} - (upto - t) // {run_chars}) as runs from run)
select {", ".join(DOC_COLUMNS)}, CAST(curve_index AS INTEGER) as curve_index, CAST(first + {order_hash_sql("doc_id", "shard")} % runs AS BIGINT) as run_id
from {last} join cut using (curve_index)"""
