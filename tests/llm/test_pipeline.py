"""The pipeline against the plain Python versions of its stages, and the driver's contract."""

import brute
import numpy as np
from test_mixing_fill import filled

import corpus_pipeline
from lignum.llm import langid

SF = "/root/testdata/sf0.001"


def test_equals_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    model = langid.fit(docs)
    found = langid.label_texts(model, [r[1] for r in rows]).to_pylist()
    rows = [r for r, x in zip(rows, found) if x["n_words"] and x["share"] >= 0.4 and x["recognised"]]
    x, d2 = brute.squared_distances([(r[2], r[3], r[1]) for r in rows])
    rows = [r for r, v, d in zip(rows, x, d2) if not brute.outlier(not np.isnan(v[0]), d)]
    gone = brute.near_duplicates([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if r[0] not in gone]
    taken = filled([(r[0], r[3], r[1]) for r in rows])  # the stage fills: a source that runs out gives all it has
    rows = [rows[k] for k in sorted(taken)]
    want = brute.packing([(r[0], r[3], r[1]) for r in rows])
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.window_id)
    assert [list(zip(r.doc_ids, r.sources, r.starts, r.counts)) for r in got] == want and want


def test_stages_return_the_columns_of_documents(spark, odd, no_docs):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "mixing", "packing"]
    for table in (odd.select(names), no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == names
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()


def test_registered():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert [n for k in range(1, 11) if not any((n := f"op{k}_") == x[: len(n)] for x in names)] == []
    assert "pipeline" in names and "pipeline" not in sql and {"op3_mixture_packing", "op6_hilbert_shards", "op10_source_mixing"} <= set(sql)
