import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lignum.llm import langid


@pytest.fixture(scope="module")
def rows(docs):
    return [r for r in docs.select("text", "lang", "doc_id").collect() if r.text]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    model = langid.Model(["x", "y", "z"], first=rng.normal(size=3), move=rng.normal(size=(3, 3)))
    w = langid.words_of(["aa bb cc\ndd ee", "ff"])
    e = rng.normal(size=(3, 6))
    post, xi = langid.forward_backward(model, w, e, expected=True)
    pairs = np.zeros((3, 3))
    for begin, n in zip(w.starts, w.lengths):
        total, want = 0.0, np.zeros((3, n))
        local = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(model.first[path[0]] + sum(e[s, begin + k] for k, s in enumerate(path)) + sum(model.move[a, b] for a, b in itertools.pairwise(path)))
            total += p
            for k, s in enumerate(path):
                want[s, k] += p
            for a, b in itertools.pairwise(path):
                local[a, b] += p
        np.testing.assert_allclose(post[:, begin : begin + n], want / total, rtol=1e-6)
        pairs += local / total
    np.testing.assert_allclose(xi, pairs, rtol=1e-6)


def test_held_out_words_of_code_switched_text(rows):
    rows = sorted((r for r in rows if r.text[0].isupper() and "!!" not in r.text), key=lambda r: r.doc_id)
    model = langid.train([(r.text, r.lang) for r in rows if r.doc_id % 2])
    right = total = 0
    texts, truth = [], []
    held = [r for r in rows if not r.doc_id % 2]
    for a, b in zip(held, held[1:]):
        x, y = a.text.split()[:30], b.text.split()[:30]
        texts.append(" ".join(x + y))
        truth.append((len(langid.words_of([" ".join(x)]).owner), a.lang, b.lang))
    for text, (cut, a, b) in zip(texts, truth):
        r = langid.label_texts(model, [text]).to_pylist()[0]
        said = [g for g, n in zip(r["span_langs"], r["span_words"]) for _ in range(n)]
        right += sum(g == (a if k < cut else b) for k, g in enumerate(said))
        total += len(said)
    assert right / total > 0.93


def test_spans_cover_all_words(rows):
    model = langid.train([(r.text, r.lang) for r in rows])
    for r, text in zip(langid.label_texts(model, [x.text for x in rows]).to_pylist(), [x.text for x in rows]):
        w = langid.words_of([text])
        n = 0 if w is None else len(w.owner)
        assert r["n_words"] == n == sum(r["span_words"])
        assert r["span_starts"] == [sum(r["span_words"][:k]) for k in range(len(r["span_words"]))]


def test_odd_rows(odd, odd_rows):
    got = langid.identify(odd)
    assert got.columns == ["doc_id", "label", "share", "confidence", "n_words", "span_langs", "span_starts", "span_words", "accepted"]
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for k in (3, 4, 8, 9):
        assert by[k].label is None and by[k].n_words == 0 and not by[k].accepted and by[k].share == 0
    assert by[7].label == "de" and by[7].n_words == 160_000 and by[10].label == "de"
    assert by[1].label == by[5].label == "en"
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id or 0) for r in rows if r.accepted)


def test_clean_documents_stay(docs):
    kept = langid.keep_identified(docs)
    assert kept.count() >= 0.99 * docs.filter(F.length(F.trim("text")) > 0).count()


def test_nothing_known(no_docs, spark):
    assert langid.identify(no_docs).collect() == [] and langid.keep_identified(no_docs).collect() == []
    alone = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(alone).select("label", "accepted").collect() == [(None, False)]


def test_cuts_change_nothing(monkeypatch):
    """Posteriors of cut lines are those of whole lines."""
    model = langid.train([("the cat sat on the mat and the dog ran", "en"), ("der hund lief und die katze sass auf der matte", "de")] * 4)
    texts = ["the hund sat und the cat ran der katze " * 9 + "\nthe dog", "", "die katze", "a\nb\n" + "der the " * 31]
    whole, _ = langid.forward_backward(model, w := langid.words_of(texts), model.emissions(w))
    for segment in (1, 2, 3, 5, 8, 63):
        monkeypatch.setattr(langid, "SEGMENT", segment)
        cut = langid.words_of(texts)
        assert cut.goes_on.any() and (np.diff(cut.starts) > 0).all() and cut.lengths.max() <= segment
        post, _ = langid.forward_backward(model, cut, model.emissions(cut))
        assert np.allclose(post, whole, atol=1e-5)
