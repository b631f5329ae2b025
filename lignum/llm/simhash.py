"""Near duplicates by an LSH forest over 256-bit SimHash fingerprints.

Fingerprint: the set of lower-cased words of the whole text (of trigrams of
characters in scripts written without spaces) votes on each of 256 bits. Forest: L tries over fixed random permutations of the bits; a trie
is kept implicitly, as rows sorted by their permuted bits inside (trie, short
prefix) groups. Every row is a query. It starts at the recall depth d*, the
deepest prefix at which a pair at the verification radius r meets in one of
the L tries with the target recall, 1 - (1 - (1 - r/256)^d*)^L >= target; where
its subtree there is sparse, it climbs to shorter prefixes until `fill` rows
share it, which only adds recall. All rows of the subtree are verified by
Hamming distance: no cap on a bucket. d* follows log2 of the number of
distinct fingerprints, so the expected subtree keeps its size as data grow,
and L follows d*. Exact copies share a fingerprint and are folded before the
forest, so thousands of copies cost no pairs. Where texts crowd (templates that
differ in a few words), a large subtree isn't compared all with all: a search
takes whatever it has linked out of the rows still to be compared, so a cluster
of near copies costs a pass or a few and no link is lost.

Defined cases: null and empty texts, and texts without an alphanumeric
character, have no fingerprint and are in no group; a null doc_id can't be
named and is in no group; repeated rows of one doc_id are one document; words
are compared without case, punctuation, order or number of times, so texts
that differ only so are copies; ties fall to the smallest doc_id, which is the
one kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textvec
from .common import subset, written

BITS = 256
KEY_BITS = 62
DENSE = 4096  # rows of a subtree beyond which linked rows are taken out
FP = ["f0", "f1", "f2", "f3"]
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)
_FP_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in FP])


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """[n, 4] uint64 fingerprints and whether each text has one."""
    out = np.zeros((len(texts), 4), np.uint64)
    has = np.zeros(len(texts), bool)
    for first, part in textvec.chunks(texts, 400_000):
        h, owner = textvec.word_hashes(part)
        if not len(h):
            continue
        # one sort dedupes words within texts: text index above 44 bits of hash
        words = np.unique((owner.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        doc = (words >> np.uint64(44)).astype(np.int64)
        word = words & np.uint64((1 << 44) - 1)
        begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        end = np.append(begin[1:], len(doc))
        for b, e in zip(begin.tolist(), end.tolist()):
            votes = np.zeros(BITS, np.int64)
            for at in range(b, e, 8192):
                block = textvec.mix(word[at : min(e, at + 8192), None] ^ _SALTS)
                votes += np.unpackbits(block.view(np.uint8), axis=1).sum(0, dtype=np.int32)
            i = first + int(doc[b])
            out[i] = np.packbits(2 * votes > e - b).view(np.uint64)
            has[i] = True
    return out, has


@F.pandas_udf(_FP_TYPE)
def _fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        fp, has = fingerprints(texts.tolist())
        frame = pd.DataFrame(fp.view(np.int64), columns=FP).astype("Int64")
        frame.loc[~has] = pd.NA
        yield frame


def plan_forest(n: int, radius: int, target: float, slack: int = 6) -> tuple[int, int]:
    """(recall depth d*, number of tries L) for n distinct fingerprints."""
    depth = min(KEY_BITS, max(4, int(math.log2(max(n, 2))) - slack))
    meet = (1 - radius / BITS) ** depth
    return depth, max(1, math.ceil(math.log(1 - target) / math.log(1 - meet)))


def permutations(tries: int) -> np.ndarray:
    rng = np.random.default_rng(20_240_607)
    return np.stack([rng.permutation(BITS)[:KEY_BITS] for _ in range(tries)])


def trie_keys(fp: np.ndarray, perms: np.ndarray) -> np.ndarray:
    """[tries, n] keys: the first KEY_BITS permuted bits, most significant first."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1)
    keys = np.empty((len(perms), len(fp)), np.int64)
    for t, perm in enumerate(perms):
        padded = np.zeros((len(fp), 64), np.uint8)
        padded[:, 64 - KEY_BITS :] = bits[:, perm]
        keys[t] = np.packbits(padded, axis=1).view(">u8")[:, 0].astype(np.int64)
    return keys


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _pairs(lo: np.ndarray, hi: np.ndarray, block: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all j in [lo_i, hi_i), in blocks."""
    n = hi - lo
    total = np.concatenate(([0], np.cumsum(n)))
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, total[at] + block, "right")) - 1)
        size = n[at:to]
        i = np.repeat(np.arange(at, to), size)
        j = np.arange(int(size.sum())) - np.repeat(total[at:to] - total[at], size) + np.repeat(lo[at:to], size)
        yield i, j
        at = to


def _linked(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the rows that verified pairs connect; what is linked is taken out of the rows still to be compared."""
    left = np.arange(len(fp))
    stars: list[np.ndarray] = []
    while len(left):
        members, reached, left = [left[:1]], [int(left[0])], left[1:]
        while reached and len(left):
            near = np.bitwise_count(fp[left] ^ fp[reached.pop()]).sum(1, dtype=np.int32) <= radius
            if near.any():
                members.append(left[near])
                reached.extend(members[-1].tolist())
                left = left[~near]
        stars.append(np.concatenate(members))
    return np.concatenate([np.full(len(m), m[0]) for m in stars]), np.concatenate(stars)


def search_groups(group: np.ndarray, key: np.ndarray, ids: np.ndarray, fp: np.ndarray, depth: int, floor: int, radius: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (smallest id, id) of what verified pairs connect inside whole (trie, prefix) groups."""
    order = np.lexsort((ids, key, group))
    group, key, ids, fp = group[order], key[order], ids[order], fp[order]
    n = len(ids)
    lo, hi = np.arange(n), np.arange(n)
    open_ = np.ones(n, bool)
    for d in range(depth, floor - 1, -1):
        prefix = key >> (KEY_BITS - d)
        new = np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (group[1:] != group[:-1])))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        begin, count = np.repeat(start, size), np.repeat(size, size)
        take = open_ & ((count >= fill) | (d == floor))
        if d == depth:
            crowded = take[start] & (size > DENSE)
            dense = list(zip(start[crowded].tolist(), (start + size)[crowded].tolist()))
        lo[take], hi[take] = begin[take], (begin + count)[take]
        open_ &= ~take
    # ids sharing a group several times (never within one trie) and all components get the smallest row index
    parent = np.arange(n)
    own = np.arange(n)
    for at, end in dense:
        a, b = _linked(fp[at:end], radius)
        _unite(parent, at + a, at + b)
        lo[at:end] = hi[at:end] = own[at:end]
    # ahead: j in (i, hi_i); behind: j in [lo_i, i) that don't have i ahead of them
    for first, last, behind in ((own + 1, hi, False), (lo, own, True)):
        for i, j in _pairs(first, np.maximum(last, first)):
            if behind:
                unseen = hi[j] <= i  # of a dense subtree all
                i, j = i[unseen], j[unseen]
            near = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int32) <= radius
            _unite(parent, i[near], j[near])
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, parent, ids)
    root = least[parent]
    far = root != ids
    return root[far], ids[far]


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id each id is connected to; ids without edges are absent.

    Alternating large-star and small-star: one window shuffle each, hubs spill
    instead of being collected, rounds grow with the logarithm of the longest
    path. Each round is a written table.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    by_u = Window.partitionBy("u")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.select("u", "v", F.least("u", F.min("v").over(by_u)).alias("m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.select("u", "v", F.min("v").over(by_u).alias("m"))
        small = small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = written(small, "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, radius: int = 40, target_recall: float = 0.95, fill: int = 16) -> DataFrame:
    """(doc_id_a, doc_id_b): each document b to remove, with the document a of its group that stays."""
    fp = written(
        subset(docs, "doc_id", "text").filter("doc_id is not null and text is not null").select("doc_id", _fingerprint("text").alias("fp")).select("doc_id", "fp.*").filter("f0 is not null"),
        "fingerprints",
    )
    reps = written(fp.groupBy(*FP).agg(F.min("doc_id").alias("rep")), "reps")
    depth, tries = plan_forest(reps.count(), radius, target_recall)
    floor = max(0, depth - 4)
    perms = permutations(tries)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                fps = part[FP].to_numpy(np.int64)
                keys = trie_keys(fps.view(np.uint64), perms)
                n = len(part)
                many = np.tile(fps, (tries, 1))
                trie = np.repeat(np.arange(tries, dtype=np.int64), n)
                flat = keys.reshape(-1)
                yield pd.DataFrame({"g": (trie << 48) | (flat >> (KEY_BITS - floor)), "k": flat, "rep": np.tile(part["rep"].to_numpy(np.int64), tries)} | {c: many[:, q] for q, c in enumerate(FP)})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = search_groups(pdf["g"].to_numpy(), pdf["k"].to_numpy(), pdf["rep"].to_numpy(), pdf[FP].to_numpy(np.int64).view(np.uint64), depth, floor, radius, fill)
            return pd.DataFrame({"a": a, "b": b})

        for pdf in batches:
            if not len(pdf):
                continue
            g = pdf["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            if cut:
                yield run(pd.concat([*held, pdf.iloc[:cut]]))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield run(pd.concat(held))

    columns = ", ".join(f"{c} bigint" for c in FP)
    forest = reps.mapInPandas(spread, f"g bigint, k bigint, rep bigint, {columns}").repartition("g").sortWithinPartitions("g")
    roots = components(forest.mapInPandas(search, "a bigint, b bigint"))
    grouped = reps.join(roots, reps.rep == roots.id, "left").select(*FP, F.coalesce("root", "rep").alias("doc_id_a"))
    return fp.join(grouped, FP).select("doc_id_a", F.col("doc_id").alias("doc_id_b")).filter("doc_id_a <> doc_id_b").distinct()


def drop_near_duplicates(docs: DataFrame, **settings: float) -> DataFrame:
    """The documents without those that `near_duplicates` removes; wholly repeated rows stay once.

    Rows whose doc_id is null stay as they are.
    """
    names = docs.columns
    removed = near_duplicates(docs, **settings).select(F.col("doc_id_b").alias("doc_id"))
    kept = docs.join(removed, "doc_id", "left_anti").select(*names)
    again = subset(docs, "doc_id").filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not again.take(1):
        return kept
    return kept.join(again, "doc_id", "left_anti").select(*names).unionByName(kept.join(again, "doc_id", "left_semi").select(*names).dropDuplicates())
