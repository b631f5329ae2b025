"""Dependency graphs: imports become edges, edges become reachability, degrees and cycles.

Edges are (from, ord, import_path, line, to, resolved); `to` is null outside
the tree. Several imports of one file are several edges.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.tables import shared_folder
from . import imports


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lignum/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the folder that executors share and read back: lineage ends here, and sizes are known."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def analysed(files: DataFrame, extended: bool = False) -> DataFrame:
    """(path, language, content) of the files whose imports are read."""
    known = files.withColumn("language", paths.language(F.col("path")))
    languages = [*imports.SYNTAX, *(imports.EXTENDED if extended else [])]
    return known.filter(F.col("language").isin(languages) & F.col("size_bytes").between(1, imports.MAX_BYTES)).select("path", "language", "content")


def extracted(analysed_: DataFrame, extended: bool = False) -> DataFrame:
    """(from, ord, import_path, line, keys): a row for each import."""
    found = analysed_.select(F.col("path").alias("from"), imports.imports_of(F.col("content"), F.col("path"), F.col("language"), extended).alias("i"))
    return found.select("from", F.posexplode("i").alias("ord", "i")).select("from", "ord", "i.*")


def known_keys(files: DataFrame) -> DataFrame:
    """(key, to) by which imports find files: the path, the folder of a Go file, the tails of a Java file."""
    path = files.select("path").distinct()
    whole = path.select(F.concat(F.lit("f:"), "path").alias("key"), F.col("path").alias("to"))
    folder = paths.base_name(paths.parent(F.col("path")))
    go = path.filter(F.lower(paths.extension(F.col("path"))) == "go").groupBy(F.concat(F.lit("g:"), folder).alias("key")).agg(F.min("path").alias("to"))
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("j:"), F.array_join(F.slice(parts, k, F.size(parts)), "/")))
    java = path.filter(F.col("path").endswith(".java")).select(F.explode(tails).alias("key"), "path").groupBy("key").agg(F.min("path").alias("to"))
    return whole.unionByName(go).unionByName(java)


def resolve(imports_: DataFrame, known: DataFrame) -> DataFrame:
    """Edges: of an import's keys that are known, the first decides; each list of keys is looked up once."""
    lists = imports_.select("keys").distinct()
    tried = lists.select("keys", F.posexplode("keys").alias("rank", "key"))
    hits = tried.join(known, "key").groupBy("keys").agg(F.min_by("to", "rank").alias("to"))
    edges = imports_.join(hits, "keys", "left")
    return edges.select("from", "ord", "import_path", "line", "to", F.col("to").isNotNull().alias("resolved"))


def edges_of(files: DataFrame, extended: bool = False) -> DataFrame:
    return resolve(written(extracted(analysed(files, extended), extended), "imports"), known_keys(files))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_if("resolved").alias("internal_edges"), F.count_if(~F.col("resolved")).alias("external_edges"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (path, language) with imports_count and imported_by_count over resolved edges, each edge counted."""
    inside = edges.filter("resolved")
    ends = inside.select(F.explode(F.array(F.struct(F.col("from").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counts = ends.groupBy("path").agg(F.sum("o").alias("imports_count"), F.sum("i").alias("imported_by_count"))
    return nodes.join(counts, "path", "left").na.fill(0, ["imports_count", "imported_by_count"])


def top(degrees_: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The `n` files with the highest count above 0, ties by path."""
    return degrees_.filter(F.col(by) > 0).select("path", F.col(by).alias("count")).orderBy(F.desc("count"), "path").limit(n)


def nodes_of(analysed_: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, language): analysed files, and resolved targets, whose language is null unless analysed."""
    targets = edges.filter("resolved").select(F.col("to").alias("path"), F.lit(None).cast("string").alias("language"))
    return analysed_.select("path", "language").unionByName(targets).groupBy("path").agg(F.max("language").alias("language"))


def under(path: Column, roots: Sequence[str]) -> Column:
    """Whether a path is one of the roots or below one, as plain strings."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r + "/")
    return out


def reachable(roots: DataFrame, edges: DataFrame, depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(path, distance) of what is within depth + 1 steps of the roots (path), or at any distance.

    A frontier of new nodes is joined to the edges each round. Rounds are
    partitions of one written table, so each writes only what is new, a lost
    executor costs a round at most, and an empty round ends the search.
    """
    a, b = ("to", "from") if reverse else ("from", "to")
    steps = written(edges.filter("resolved").select(F.col(a).alias("path"), F.col(b).alias("next")).distinct(), "steps")
    spark = edges.sparkSession
    folder = f"{scratch(spark)}/reached-{uuid.uuid4().hex}"
    roots.select("path").distinct().write.parquet(f"{folder}/distance=0")
    at = 0
    while depth is None or at <= depth:
        frontier = spark.read.schema("path string").parquet(f"{folder}/distance={at}")
        seen = spark.read.schema("path string").parquet(*[f"{folder}/distance={k}" for k in range(at + 1)])
        at += 1
        new = frontier.join(steps, "path").select(F.col("next").alias("path")).distinct().join(seen, "path", "left_anti")
        new.write.parquet(f"{folder}/distance={at}")
        if not spark.read.schema("path string").parquet(f"{folder}/distance={at}").take(1):
            break
    return spark.read.schema("path string, distance int").parquet(folder)


def subset(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from the nodes (path) to one of them or out of the tree."""
    starts = edges.join(nodes.select(F.col("path").alias("from")), "from", "left_semi")
    return starts.filter("not resolved").unionByName(starts.filter("resolved").join(nodes.select(F.col("path").alias("to")), "to", "left_semi").select(*starts.columns))


def on_cycles(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Resolved edges without those into nodes that lead nowhere, again and again: all cycles stay.

    Only nodes without a way out may go; dropping those without a way in would
    change where the search enters a ring.
    """
    now = written(edges.filter("resolved").select("from", "ord", "to"), "ring")
    size = now.count()
    for _ in range(rounds):
        now = written(now.join(now.select(F.col("from").alias("to")).distinct(), "to", "left_semi"), "ring")
        left = now.count()
        if left in (0, size):
            break
        size = left
    return now.select("from", "ord", "to")


def find_cycles(edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """The back edges of a depth-first search as closed paths, each set of files once.

    Edges come in order of (from, position); the search starts at nodes in
    order of path and follows imports in their order. It can't be spread, so
    it gets the few edges that `on_cycles` leaves.
    """
    follow: dict[str, list[str]] = {}
    for a, b in edges:
        follow.setdefault(a, []).append(b)
        follow.setdefault(b, [])
    done: set[str] = set()
    known: set[tuple[str, ...]] = set()
    cycles: list[list[str]] = []
    for root in sorted(follow):
        if root in done:
            continue
        trail, place, ways = [root], {root: 0}, [iter(follow[root])]
        while trail:
            step = next(ways[-1], None)
            if step is None:
                ways.pop()
                done.add(trail[-1])
                del place[trail.pop()]
            elif step in place:
                ring = [*trail[place[step] :], step]
                if (key := tuple(sorted(ring))) not in known:
                    known.add(key)
                    cycles.append(ring)
            elif step not in done:
                place[step] = len(trail)
                trail.append(step)
                ways.append(iter(follow[step]))
    return cycles


def cycles(edges: DataFrame) -> list[list[str]]:
    rows = on_cycles(edges).orderBy("from", "ord").toLocalIterator()
    return find_cycles((r["from"], r["to"]) for r in rows)


def cycles_table(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(cycle_id, files)"""
    return spark.createDataFrame([(k, c) for k, c in enumerate(cycles(edges))], "cycle_id long, files array<string>")
