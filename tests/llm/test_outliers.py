import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lignum.llm import outliers


@pytest.fixture(scope="module")
def scored(docs):
    return docs.join(outliers.score(docs).select("doc_id", "d2", "rejected"), "doc_id").collect()


def test_equals_brute_force(scored):
    x, want = brute.squared_distances([(r.lang, r.source, r.text) for r in scored])
    for r, v, d2 in zip(scored, x, want):
        assert (r.d2 is None) == (d2 is None)
        if d2 is not None:
            assert math.isclose(r.d2, d2, rel_tol=1e-3, abs_tol=1e-3)
        assert r.rejected == brute.outlier(not np.isnan(v[0]), r.d2)


def test_junk_goes_and_clean_stays(scored, spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    good = [r.rejected for r in scored if labels.get(r.doc_id) == 1]
    bad = [r.rejected for r in scored if labels.get(r.doc_id) == 0]
    assert np.mean(good) < 0.02 and np.mean(bad) > 0.8


def test_planted_outliers_in_their_group(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda"]
    rows = [(k, " ".join(rng.choice(words, 60)) + ".", "en", "a", 0) for k in range(300)]
    rows += [(900 + k, "BUY!!! $$$ NOW ### " * 20, "en", "a", 0) for k in range(30)]  # a tenth: plain means would follow them
    got = {r.doc_id: r.rejected for r in outliers.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(got[900 + k] for k in range(30)) and sum(got[k] for k in range(300)) <= 3


def test_odd_rows(odd, odd_rows):
    rows = outliers.score(odd).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[k].rejected and by[k].d2 is None for k in (3, 4, 8, 9))
    assert not by[1].rejected and not by[7].rejected  # too few vectors for an estimate
    kept = outliers.keep_inliers(odd)
    assert kept.columns == odd.columns and kept.count() == sum(not r.rejected for r in rows)


def test_long_text_and_null_groups_with_estimates(spark, odd, docs):
    many = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(odd.select(docs.columns))
    rows = outliers.score(many, min_group=5).filter("doc_id is null or doc_id <= 10").collect()
    assert all(r.rejected == (r.d2 is None or r.d2 > outliers.cut(0.999, 1.1)) for r in rows)


def test_empty(no_docs):
    assert outliers.score(no_docs).collect() == [] and outliers.keep_inliers(no_docs).collect() == []
