"""Mixtures in which a source that runs out gives all it has."""

from collections import defaultdict

import brute
import pytest

import corpus_pipeline
from lignum.llm import mixing

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def filled(rows, weights=None):
    """Indices of the rows taken, of (doc_id, source, text)."""
    by = defaultdict(list)
    for k, (i, source, text) in enumerate(rows):
        by[source].append((brute.order_hash(i, "mix"), k, brute.tokens(text)))
    weight = {s: 1 if weights is None else weights.get(s, 0) for s in by}
    total = {s: sum(t for *_, t in q) for s, q in by.items() if weight[s] > 0}
    steps = sorted((-(-t // weight[s]), t) for s, t in total.items() if t)
    unit, seen = 0, 0
    for u, t in steps:
        unit, seen = u, seen + t
        if 2 * seen >= sum(total.values()):
            break
    taken = set()
    for s in total if steps else ():
        used = {h: sum(t for g, _, t in by[s] if g <= h) for h, *_ in by[s]}
        taken |= {k for h, k, _ in by[s] if used[h] <= min(total[s], unit * weight[s])}
    return taken


@pytest.mark.parametrize("weights", [None, {"src0": 5, "src1": 2, "src3": 1}])
def test_equals_brute_force(docs, weights):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    kept = sorted(r.doc_id for r in mixing.keep_mixture(docs, weights, fill=True).collect())
    assert kept == sorted(rows[k][0] for k in filled(rows, weights))


def test_a_stray_source_does_not_empty_the_stage(spark, docs):
    stray = spark.createDataFrame([(10**9, "just five words of text", "en", "stray", 23), (10**9 + 1, "no source", "en", None, 9)], "doc_id long, text string, lang string, source string, n_chars long")
    table = docs.select(NAMES).unionByName(stray)
    kept = corpus_pipeline.mixing_to_weights(spark, table, "").collect()
    assert {10**9, 10**9 + 1} <= {r.doc_id for r in kept}
    assert sum(brute.tokens(r.text) for r in kept) >= 0.5 * sum(brute.tokens(r.text) for r in table.collect())
    assert {s for _, s in {(r.doc_id, r.source) for r in kept}} == {r.source for r in table.select("source").distinct().collect()}


def test_nothing(no_docs, odd):
    assert mixing.keep_mixture(no_docs, fill=True).collect() == []
    assert mixing.keep_mixture(odd, {"zzz": 5}, fill=True).collect() == []
