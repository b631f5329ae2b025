import brute
import pytest

from lignum.llm import packing


def windows(df):
    rows = sorted(df.collect(), key=lambda r: r.window_id)
    assert [r.window_id for r in rows] == list(range(len(rows)))
    assert all(r.n_tokens == sum(r.counts) for r in rows)
    return [list(zip(r.doc_ids, r.sources, r.starts, r.counts)) for r in rows]


@pytest.mark.parametrize(("weights", "window", "piece"), [(None, 8192, 1024), ({"a": 2, "b": 1, None: 1}, 64, 16), ({"b": 1}, 1000, 1000), ({"zzz": 1}, 64, 16)])
def test_odd_rows_equal_brute_force(odd, odd_rows, weights, window, piece):
    want = brute.packing([(r[0], r[3], r[1]) for r in odd_rows], weights, window, piece)
    assert windows(packing.pack(odd, weights, window, piece)) == want


@pytest.mark.parametrize("weights", [None, {f"src{k}": 1 + k for k in range(20)}])
def test_tables_equal_brute_force(docs, weights):
    want = brute.packing([(r.doc_id, r.source, r.text) for r in docs.collect()], weights, 512, 128)
    assert windows(packing.pack(docs, weights, 512, 128)) == want


def test_many_buckets(docs, monkeypatch):
    want = windows(packing.pack(docs, None, 512, 128))
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    monkeypatch.setattr(packing, "ROUNDS", 2)
    assert windows(packing.pack(docs, None, 512, 128)) == want


def test_sql_twin(odd, duck):
    plain = odd.select("doc_id", "text", "source")
    got = sorted(duck(packing.pack_sql(window=256, piece=64), plain), key=lambda r: r["window_id"])
    assert [list(zip(r["doc_ids"], r["sources"], r["starts"], r["counts"])) for r in got] == windows(packing.pack(plain, None, 256, 64))


def test_every_token_once(docs):
    covered = {}
    for w in windows(packing.pack(docs)):
        for i, _, start, n in w:
            covered.setdefault(i, []).append((start, n))
    for r in docs.collect():
        at = 0
        for start, n in sorted(covered.get(r.doc_id, [])):
            assert start == at
            at += n
        assert at == brute.tokens(r.text)


def test_proportions_hold_in_windows(docs):
    weights = {"src0": 2, "src1": 1}
    full = windows(packing.pack(docs, weights, 512, 64))
    both = [w for w in full if {s for _, s, _, _ in w} == {"src0", "src1"}]
    done = {"src0": 0, "src1": 0}
    for w in both[:-1]:
        for _, s, _, n in w:
            done[s] += n
        assert abs(done["src0"] - 2 * done["src1"]) < 2 * (512 + 64)


def test_empty_and_wrong_sizes(no_docs):
    assert packing.pack(no_docs).collect() == []
    with pytest.raises(ValueError):
        packing.pack(no_docs, window=10, piece=11)
