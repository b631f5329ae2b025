"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents in order of a hash of doc_id;
documents longer than `piece` tokens queue as pieces. In every round a source's
deficit grows by its quantum, its share of a window's tokens, and it serves
whole pieces while they fit the deficit; the rest is carried to the next round.
A source with backlog has thus served a piece that ends at position c of its
queue by round ceil(c / quantum), so the rounds need no loop: prefix sums by
source give each piece's round, prefix sums over rounds its place in the
output, and windows are cut every `window` tokens, splitting a piece at a cut.
Deficits stay below one piece, so at each cut every source has served its
target to within a piece and a round. An exhausted source drops out and the
others keep their proportions.

Both prefix sums are two-level (bucket totals, then inside buckets), so no
task sees a whole source: queue buckets hold about `BUCKET_ROWS` documents and
round buckets `ROUNDS` rounds, or more where that would give more than `BUCKETS`
of them, whose totals one task sums up.

Target proportions are integer weights by source; without any, the sources'
own tokens, so that all queues end together.

Defined cases: null, empty and blank texts have no tokens and are in no
window; null source is a queue of its own, weighted under the key None; a
source without weight is left out; repeated rows and a null doc_id queue by
the same hash, ties in order of doc_id and then of size, and each is packed;
the last window may be short; an empty table gives no windows; extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import order_hash, order_hash_sql, subset, token_count, token_count_sql, written

SALT = "pack"
WINDOW = 8192
PIECE = 1024
BUCKET_ROWS = 4096
ROUNDS, BUCKETS = 64, 1 << 16




def pack(docs: DataFrame, weights: dict[str | None, int] | None = None, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """A row for each window: window_id, n_tokens, and in order of its pieces doc_ids, sources, starts and counts of tokens."""
    if not 0 < piece <= window:
        raise ValueError("a piece must have 1 token or more and fit in a window")
    slim = written(
        subset(docs, "doc_id", "source", "text").select("doc_id", F.struct("source").alias("s"), order_hash(F.col("doc_id"), SALT).alias("h"), token_count(F.col("text")).alias("tokens")).filter("tokens > 0"),
        "slim",
    )
    totals = slim.groupBy("s").agg(F.sum("tokens").alias("n"))
    if weights is not None:
        known = F.lit(0)
        for source, w in weights.items():
            known = F.when(F.col("s.source").eqNullSafe(F.lit(source)), F.lit(w)).otherwise(known)
        totals = totals.withColumn("n", known.cast("bigint")).filter("n > 0")
    whole = totals.agg(F.sum("n").alias("whole"))
    quanta = written(totals.crossJoin(F.broadcast(whole)).select("s", F.greatest(F.lit(1), F.expr(f"cast({window} * (n / whole) as bigint)")).alias("quantum")), "quanta")

    bits = max(0, math.ceil(math.log2(max(1, slim.count()) / BUCKET_ROWS)))
    queued = slim.join(quanta, "s").withColumn("b", F.shiftright("h", 60 - bits))
    sizes = queued.groupBy("s", "b").agg(F.sum("tokens").alias("t"))
    in_order = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("s", "b", F.coalesce(F.sum("t").over(in_order), F.lit(0)).alias("base"))
    queue = Window.partitionBy("s", "b").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = queued.join(bases, ["s", "b"]).withColumn("at", F.col("base") + F.coalesce(F.sum("tokens").over(queue), F.lit(0)))
    pieces = placed.select("s", "doc_id", "at", "tokens", "quantum", F.explode(F.sequence(F.lit(0), F.expr(f"(tokens - 1) div {piece}"))).alias("k"))
    pieces = pieces.select("s", "doc_id", F.expr(f"k * {piece}").alias("start"), F.expr(f"least({piece}, tokens - k * {piece})").alias("n"), (F.col("at") + F.expr(f"k * {piece}")).alias("at"), "quantum")
    pieces = written(pieces.withColumn("round", F.expr("(at + n + quantum - 1) div quantum")).drop("quantum"), "pieces")
    rounds = max(ROUNDS, math.ceil((pieces.agg(F.max("round")).first()[0] or 0) / BUCKETS))
    pieces = pieces.withColumn("rb", F.expr(f"round div {rounds}"))

    by_rounds = pieces.groupBy("rb").agg(F.sum("n").alias("t"))
    along = Window.orderBy("rb").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    offsets = by_rounds.select("rb", F.coalesce(F.sum("t").over(along), F.lit(0)).alias("base"))
    served = Window.partitionBy("rb").orderBy("round", "s", "at").rowsBetween(Window.unboundedPreceding, -1)
    out = pieces.join(offsets, "rb").withColumn("offset", F.col("base") + F.coalesce(F.sum("n").over(served), F.lit(0)))
    first, last = F.expr(f"offset div {window}"), F.expr(f"(offset + n - 1) div {window}")
    cut = out.select("s", "doc_id", "start", "n", "offset", F.explode(F.sequence(first, last)).alias("window_id"))
    lo, hi = F.greatest("offset", F.expr(f"window_id * {window}")), F.least(F.col("offset") + F.col("n"), F.expr(f"(window_id + 1) * {window}"))
    parts = cut.select("window_id", F.struct(lo.alias("place"), "doc_id", F.col("s.source").alias("source"), (F.col("start") + lo - F.col("offset")).alias("start"), (hi - lo).alias("n")).alias("part"))
    windows = parts.groupBy("window_id").agg(F.sum("part.n").alias("n_tokens"), F.array_sort(F.collect_list("part")).alias("p"))
    return windows.select("window_id", "n_tokens", *[F.col(f"p.{a}").alias(b) for a, b in (("doc_id", "doc_ids"), ("source", "sources"), ("start", "starts"), ("n", "counts"))])


def pack_sql(table: str = "documents", window: int = WINDOW, piece: int = PIECE) -> str:
    """The same windows at the sources' own proportions, by plain running sums."""
    return f"""
with slim as (select doc_id, source, {order_hash_sql("doc_id", SALT)} as h, {token_count_sql("text")} as tokens from {table}),
filled as (select * from slim where tokens > 0),
quanta as (select source, greatest(1, CAST(floor({window} * (CAST(sum(tokens) AS DOUBLE) / (select sum(tokens) from filled))) AS BIGINT)) as quantum from filled group by source),
placed as (select s.*, quantum, coalesce(sum(tokens) over (partition by s.source order by h, doc_id nulls first, tokens rows between unbounded preceding and 1 preceding), 0) as pos
           from filled s join quanta q on s.source is not distinct from q.source),
pieces as (select source, doc_id, k * {piece} as start, least({piece}, tokens - k * {piece}) as n, pos + k * {piece} as pos, quantum
           from (select *, unnest(range(0, (tokens - 1) // {piece} + 1)) as k from placed)),
rounds as (select *, (pos + n + quantum - 1) // quantum as round from pieces),
served as (select *, coalesce(sum(n) over (order by round, source nulls first, pos rows between unbounded preceding and 1 preceding), 0) as off from rounds),
cut as (select *, unnest(range(CAST(off // {window} AS BIGINT), CAST((off + n - 1) // {window} + 1 AS BIGINT))) as window_id from served),
parts as (select window_id, doc_id, source, greatest(off, window_id * {window}) as lo, least(off + n, (window_id + 1) * {window}) as hi, start, off from cut)
select window_id, CAST(sum(hi - lo) AS BIGINT) as n_tokens, list(doc_id order by lo) as doc_ids, list(source order by lo) as sources,
       list(CAST(start + lo - off AS BIGINT) order by lo) as starts, list(CAST(hi - lo AS BIGINT) order by lo) as counts
from parts group by window_id"""
