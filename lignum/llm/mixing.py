"""Mixing sources to target weights by hash-threshold histograms.

A document's position in its source is a hash of its doc_id, so "keep what
hashes to at most t" is a uniform sample that any task can take on its own.
Tokens are summed by (source, hash bucket); for each budget the histogram
tells the bucket in which the source's budget is reached, and only documents
of that boundary bucket are looked at again: a second histogram inside it,
then a running sum over the few left. The thresholds (a row for each source
and budget) then filter the documents without a sort.

Budgets: with total tokens A_s and integer weights w_s, the largest mixture
without repeats has T = min floor(A_s / w_s) tokens a weight unit, over the
sources that have tokens and weight; the budget of a source at `pct` is
T * w_s * pct / 100, rounded down, and its threshold is the largest hash with
the documents up to it holding at most the budget. Thresholds of smaller
budgets are smaller, so the samples are nested.

With `fill` a source that runs out gives all it has instead of holding the
others down: T is the smallest A_s / w_s, rounded up, such that the sources up
to it hold half of all tokens, and a source's full budget is min(A_s, T * w_s).
So a mixture keeps at least half of the tokens, whatever small sources there are.

Defined cases: null and empty texts have no tokens and cost nothing, so they
are taken by their hash alone; null source is a source of its own, weighted
under the key None; a source without weight is dropped; a null doc_id hashes as
'null'; rows of equal hash (repeated rows) are taken or left together; if no
source has tokens and weight nothing is taken; an empty table gives no rows;
extra columns are ignored or carried untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import order_hash, order_hash_sql, subset, token_count, token_count_sql, written

SALT = "mix"
HASH_BITS = 60
BUDGETS = (25, 50, 100)


def _weight(weights: dict[str | None, int] | None) -> Column:
    """The integer weight of `source`: 1 for all where no weights are given."""
    if weights is None:
        return F.lit(1).cast("bigint")
    known = F.lit(0)
    for source, w in weights.items():
        known = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(w)).otherwise(known)
    return known.cast("bigint")


def thresholds(slim: DataFrame, weights: dict[str | None, int] | None, budgets: tuple[int, ...], bits: int = 12, fill: bool = False) -> DataFrame:
    """(source, pct, threshold) of a (source, h, tokens) table; -1 takes nothing."""
    by_bucket = slim.groupBy("source", F.shiftright("h", HASH_BITS - bits).alias("b1")).agg(F.sum("tokens").alias("t"))
    hist = written(by_bucket, "histogram")
    totals = hist.groupBy("source").agg(F.sum("t").alias("total")).withColumn("w", _weight(weights)).filter("w > 0")
    unit = totals.filter("total > 0").agg(F.min(F.expr("total div w")).alias("unit"))
    full = F.expr("unit * w")
    if fill:
        steps = totals.filter("total > 0").groupBy(F.expr("(total + w - 1) div w").alias("u")).agg(F.sum("total").alias("t"))  # a row for each size of a source
        upto, whole = F.sum("t").over(Window.orderBy("u")), F.sum("t").over(Window.partitionBy())
        unit = steps.select("u", (2 * upto >= whole).alias("enough")).filter("enough").agg(F.min("u").alias("unit"))
        full = F.expr("least(total, unit * w)")
    pct = F.explode(F.array(*[F.lit(int(p)) for p in budgets])).alias("pct")
    goals = written(totals.crossJoin(F.broadcast(unit)).select("source", pct, "total", full.alias("full")).select("source", "pct", F.expr("full * pct div 100").alias("budget")), "goals")

    def boundary(parts: DataFrame, goals_: DataFrame, low: str, base: Column) -> DataFrame:
        """The first part in which the running sum passes the budget, with what came before; none where all fits."""
        running = Window.partitionBy("source", "pct").orderBy(low).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = parts.join(goals_, "source_key").select("source", "pct", "budget", low, "t", (base + F.sum("t").over(running)).alias("upto"))
        return upto.filter("upto > budget").groupBy("source", "pct", "budget").agg(F.min(F.struct(low, (F.col("upto") - F.col("t")).alias("before"))).alias("x")).select("source", "pct", "budget", f"x.{low}", "x.before")

    # null sources join as a key of their own
    key = F.struct("source").alias("source_key")
    keyed = goals.select(key, "source", "pct", "budget")
    first = written(boundary(hist.select(key, "b1", "t"), keyed, "b1", F.lit(0)), "boundary1")
    # inside the boundary buckets only
    inner = slim.select(key, "h", "tokens", F.shiftright("h", HASH_BITS - bits).alias("b1"))
    edge = first.select(key, "source", "pct", "budget", "b1", "before")
    inside = inner.join(edge, ["source_key", "b1"])
    sub = F.shiftright("h", HASH_BITS - 2 * bits)
    running = Window.partitionBy("source", "pct").orderBy("b2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    second = inside.groupBy("source", "pct", "budget", "before", sub.alias("b2")).agg(F.sum("tokens").alias("t")).withColumn("upto", F.col("before") + F.sum("t").over(running)).filter("upto > budget")
    second = written(second.groupBy("source", "pct", "budget").agg(F.min(F.struct("b2", (F.col("upto") - F.col("t")).alias("before"))).alias("x")).select("source", "pct", "budget", "x.*"), "boundary2")
    leaf = slim.select(key, "h", "tokens", sub.alias("b2")).join(second.select(key, "source", "pct", "budget", "b2", "before"), ["source_key", "b2"])
    by_hash = leaf.groupBy("source", "pct", "budget", "before", "h").agg(F.sum("tokens").alias("t"))
    along = Window.partitionBy("source", "pct").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = by_hash.withColumn("upto", F.col("before") + F.sum("t").over(along)).filter("upto > budget").groupBy("source", "pct").agg(F.min("h").alias("stop"))
    stops = stop.select(key, "pct", "stop")
    # everything below the first hash that passes the budget; all where none does
    return written(keyed.join(stops, ["source_key", "pct"], "left").select("source", "pct", (F.coalesce("stop", F.lit(1 << HASH_BITS)) - 1).alias("threshold")), "thresholds")


def _slim(docs: DataFrame) -> DataFrame:
    return subset(docs, "doc_id", "source", "text").select("doc_id", "source", order_hash(F.col("doc_id"), SALT).alias("h"), token_count(F.col("text")).alias("tokens"))


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(doc_id, source, tokens, pct): the documents taken, with the smallest budget that takes them."""
    slim = written(_slim(docs), "slim")
    limits = thresholds(slim, weights, budgets).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("pct", "threshold"))).alias("limits")).select(F.col("source").alias("limit_source"), "limits")
    taken = slim.join(limits, F.col("source").eqNullSafe(F.col("limit_source")))
    smallest = F.filter("limits", lambda x: F.col("h") <= x["threshold"])
    return taken.withColumn("fits", smallest).filter(F.size("fits") > 0).select("doc_id", "source", "tokens", F.col("fits")[0]["pct"].alias("pct"))


def keep_mixture(docs: DataFrame, weights: dict[str | None, int] | None = None, fill: bool = False) -> DataFrame:
    """The rows of the full mixture, all columns as they were."""
    names = docs.columns
    limits = thresholds(written(_slim(docs).drop("doc_id"), "slim"), weights, (100,), fill=fill).select(F.col("source").alias("limit_source"), "threshold")
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col("source"), order_hash(F.col("doc_id"), SALT).alias("h"))
    return rows.join(limits, F.col("source").eqNullSafe(F.col("limit_source"))).filter("h <= threshold").select("row.*")


def mix_sql(table: str = "documents", budgets: tuple[int, ...] = BUDGETS) -> str:
    """Equal weights, by a running sum over every source in order of hash."""
    pct = ", ".join(f"({p})" for p in budgets)
    return f"""
with slim as (select doc_id, source, {order_hash_sql("doc_id", SALT)} as h, {token_count_sql("text")} as tokens from {table}),
totals as (select source, sum(tokens) as total from slim group by source),
goal as (select pct, (select coalesce(min(total), 0) from totals where total > 0) * pct // 100 as budget from (values {pct}) p(pct)),
run as (select *, sum(tokens) over (partition by source order by h range between unbounded preceding and current row) as upto from slim)
select doc_id, source, tokens, CAST(min(pct) AS INTEGER) as pct from run join goal on upto <= budget
where exists (select 1 from totals where total > 0)
group by doc_id, source, tokens, h, upto"""
