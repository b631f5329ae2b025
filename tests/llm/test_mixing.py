import brute
import pytest

from lignum.llm import mixing


def as_set(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.source or "", r.tokens, r.pct) for r in df.collect())


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1, None: 1}, {"a": 1}, {"zzz": 5}])
def test_odd_rows_equal_brute_force(odd, odd_rows, weights):
    rows = [(r[0], r[3], r[1]) for r in odd_rows]
    want = sorted((rows[k][0] if rows[k][0] is not None else -1, rows[k][1] or "", brute.tokens(rows[k][2]), p) for k, p in brute.mixture(rows, weights).items())
    assert as_set(mixing.mix(odd, weights)) == want


def test_tables_equal_brute_force(docs):
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    taken = brute.mixture(rows)
    assert as_set(mixing.mix(docs)) == sorted((rows[k][0], rows[k][1], brute.tokens(rows[k][2]), p) for k, p in taken.items())
    few = {"src0": 5, "src1": 2, "src3": 1}
    kept = mixing.keep_mixture(docs, few)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[k][0] for k in brute.mixture(rows, few, (100,)))


def test_sql_twin(odd, duck):
    got = sorted((r["doc_id"] or -1, r["source"] or "", r["tokens"], r["pct"]) for r in duck(mixing.mix_sql(), odd.select("doc_id", "text", "source").distinct()))
    assert got == as_set(mixing.mix(odd.select("doc_id", "text", "source").distinct()))


def test_nested(docs):
    got = mixing.mix(docs, budgets=(10, 20, 40)).collect()
    some = {p: {r.doc_id for r in mixing.mix(docs, budgets=(p,)).collect()} for p in (10, 20, 40)}
    assert some[10] <= some[20] <= some[40] == {r.doc_id for r in got}


def test_empty(no_docs):
    assert mixing.mix(no_docs).collect() == [] and mixing.keep_mixture(no_docs).collect() == []
