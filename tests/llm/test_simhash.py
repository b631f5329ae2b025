import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lignum.llm import simhash


def removed(df):
    return {r.doc_id_b: r.doc_id_a for r in df.collect()}


def test_equals_comparing_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, want = removed(simhash.near_duplicates(docs)), brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 50
    same = sum(got.get(k) == v for k, v in want.items())
    assert same >= 0.95 * len(want) and set(got) <= set(want)


def test_whole_texts_count(spark):
    words = [f"w{k}" for k in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:15_000] + [f"v{k}" for k in range(15_000)])), (3, " ".join(reversed(words)))]
    assert removed(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == {3: 1}


def test_thousands_of_copies_and_chains(spark):
    base = [f"t{k}" for k in range(400)]
    rows = [(5000 + k, " ".join(base)) for k in range(3000)]
    rows += [(k, " ".join(base[8 * k :] + [f"u{j}" for j in range(8 * k)])) for k in range(1, 4)]
    got = removed(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(got) == 3002 and set(got.values()) == {1}


def test_crowds(spark, monkeypatch):
    """Templates that differ in a few words, and some unlike texts."""
    monkeypatch.setattr(simhash, "DENSE", 16)
    base = [f"t{k}" for k in range(300)]
    rows = [(k, " ".join(base[:-6] + [f"x{k}y{j}" for j in range(6)])) for k in range(400)]
    rows += [(1000 + k, " ".join(f"z{k}q{j}" for j in range(80))) for k in range(100)] + [(2000, " ".join(f"z7q{j}" for j in range(79)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(simhash.near_duplicates(docs)) == brute.near_duplicates(rows) == dict.fromkeys(range(1, 400), 0) | {2000: 1007}


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 30), st.integers(0, 99), st.integers(0, 60))
def test_links_of_a_dense_subtree(n, seed, radius):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, (4, 4)).astype(np.uint64)
    fp = centres[rng.integers(0, 4, n)] ^ (np.uint64(1) << rng.integers(0, 63, (n, 4)).astype(np.uint64))
    a, b = simhash._linked(fp, radius)
    got = dict(zip(b.tolist(), a.tolist()))
    want = list(range(n))
    for _ in range(n):
        for i in range(n):
            near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]).sum(1) <= radius)
            least = min(want[j] for j in near)
            for j in near:
                want[j] = least
    assert [min(k for k in got if got[k] == got[i]) for i in range(n)] == want


def test_odd_rows(odd, odd_rows):
    got = simhash.near_duplicates(odd)
    assert got.columns == ["doc_id_a", "doc_id_b"] and removed(got) == {2: 1}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 9, 10]


def test_empty(no_docs):
    assert removed(simhash.near_duplicates(no_docs)) == {} and simhash.drop_near_duplicates(no_docs).collect() == []


def test_fingerprint_is_the_vote_of_the_words():
    fp, has = simhash.fingerprints(["one two three", "three TWO, one", None, "", "?!"])
    assert has.tolist() == [True, True, False, False, False] and (fp[0] == fp[1]).all() and not fp[2:].any()


def test_keys_are_the_permuted_bits():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, (5, 4)).astype(np.uint64)
    perms = simhash.permutations(3)
    bits = np.unpackbits(fp.view(np.uint8), axis=1)
    for t in range(3):
        want = [int("".join(map(str, row[perms[t]])), 2) for row in bits]
        assert simhash.trie_keys(fp, perms)[t].tolist() == want


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_pairs_are_all(ranges):
    lo = np.array([min(r) for r in ranges], np.int64)
    hi = np.array([max(r) for r in ranges], np.int64)
    got = [(int(a), int(b)) for i, j in simhash._pairs(lo, hi, 7) for a, b in zip(i, j)]
    assert got == [(k, j) for k in range(len(lo)) for j in range(lo[k], hi[k])]


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, 900), (900, 7), (3, 7), (55, 55)]
    got = {r.id: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(101, 141)} | {900: 3, 7: 3}
