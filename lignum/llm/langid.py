"""Word-level language identification by a linear-chain conditional random field.

Every run of letters is a word. Its features are all letter trigrams with word
ends as letters (so one- and two-letter affixes are among them), its first and
last four letters, and its place in a lexicon of frequent words. A transition
weight links neighbouring words of a line. Forward-backward gives each word a
posterior over the languages; the likeliest labels it. The chain starts anew
at each line. Lines of more than `SEGMENT` words are cut, to bound the sequential
steps of a batch, and what a segment does to the state is a small matrix, so the
state at each cut is exact and the posteriors are those of the whole line.

Training is on the driver, from a bounded sample of labelled documents
(`train_docs` a language, by hash of doc_id, whole texts), respliced into
code-switched sequences so that the transitions learn how rarely text switches.

Defined cases: null, empty and letterless texts have no label, share 0, and
are not accepted; texts of several languages get the one with most words, ties
to the first in alphabetical order, and are accepted if its share of words
reaches `min_share` and the text is recognised: texts in other languages or
scripts, and gibberish, have too few trigrams that the training texts have (the
least share is set by training texts held against others); rows with a null lang train nothing but are labelled; a
null doc_id is labelled like any other; repeated rows are each labelled; a
table without labelled words knows no language, so all labels are null and
nothing is accepted; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textvec
from .common import order_hash, subset

SEGMENT = 128
_ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
_TOP = 0x33000  # no letters beyond
_OTHER = 58
#: 1 to 57: letters of Latin alphabets; _OTHER: other letters, and the marks of scripts that write vowels with them
_CLASS = np.zeros(_TOP + 1, np.uint8)
_CLASS[:_TOP] = [_OTHER * (chr(_c).isalpha() or (0x483 <= _c < 0x1AB0 or 0xA800 <= _c < 0xAC00) and unicodedata.category(chr(_c))[0] == "M") for _c in range(_TOP)]
for _i, _ch in enumerate("abcdefghijklmnopqrstuvwxyz" + _ACCENTED, 1):
    _CLASS[ord(_ch)] = _CLASS[ord(_ch.upper()[0])] = _i
_CLASS[ord("ß")] = 26 + len(_ACCENTED)
#: what a character is to the features: its class, or for other letters their own small letter above the classes
_IDENTITY = _CLASS.astype(np.int64)
for _c in np.flatnonzero(_CLASS == _OTHER).tolist():
    _IDENTITY[_c] = 64 + ord(chr(_c).lower()[0])
AFFIX = 1 << 15
GRAMS = 1 << 18  # of Latin letters; as many buckets again for the hashes of other trigrams
RESULT = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("share", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("span_langs", T.ArrayType(T.StringType())),
        T.StructField("span_starts", T.ArrayType(T.IntegerType())),
        T.StructField("span_words", T.ArrayType(T.IntegerType())),
        T.StructField("recognised", T.BooleanType()),
    ]
)


@dataclass
class Words:
    """The words of a run of texts: owner text, line-bound segments and feature indices."""

    owner: np.ndarray
    starts: np.ndarray  # of segments, as word indices
    lengths: np.ndarray
    goes_on: np.ndarray  # whether a segment continues the line of the one before
    grams: np.ndarray
    gram_at: np.ndarray  # first gram of each word
    prefix: np.ndarray
    suffix: np.ndarray
    hashes: np.ndarray


def words_of(texts: list[str]) -> Words | None:
    cps, begins = textvec.codepoints(texts)
    cls = _IDENTITY[np.minimum(cps, _TOP)]
    starts, ends = textvec.runs(cls > 0)
    if not len(starts):
        return None
    wide = cls
    at = np.flatnonzero(cls)  # letters; texts end in a line feed, so at + 1 exists, and at - 1 is -1 or before
    before = wide[at - 1]  # index -1 is the closing line feed
    grams = (before << 12) | (wide[at] << 6) | wide[at + 1]
    other = np.flatnonzero((before >= 64) | (wide[at] >= 64) | (wide[at + 1] >= 64))
    if len(other):
        x = (before[other] << 42) | (wide[at[other]] << 21) | wide[at[other] + 1]
        grams[other] = GRAMS + (textvec.mix(x.astype(np.uint64)) & np.uint64(GRAMS - 1)).astype(np.int64)
    n = ends - starts
    gram_at = np.concatenate(([0], np.cumsum(n)[:-1]))
    # four letters from either end; positions beyond the word are its boundary
    pre, suf = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for k in range(4):
        pre = pre * 67 + np.where(k < n, wide[np.minimum(starts + k, ends - 1)], 0)
        suf = suf * 67 + np.where(k < n, wide[np.maximum(ends - 1 - k, starts)], 0)
    pos = np.arange(len(at)) - np.repeat(gram_at, n)
    power = np.cumprod(np.full(int(n.max()), textvec._BASE, np.uint64))
    hashes = np.add.reduceat(wide[at].astype(np.uint64) * power[pos], gram_at)
    owner = np.searchsorted(begins, starts, "right") - 1
    line = np.cumsum(cps == 10)[starts]
    fresh = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    size = np.diff(np.append(fresh, len(n)))
    pieces = -(-size // SEGMENT)
    first = np.repeat(fresh, pieces)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    seg = first + nth * SEGMENT
    return Words(owner, seg, np.diff(np.append(seg, len(n))), nth > 0, grams, gram_at, pre % AFFIX, suf % AFFIX, hashes)


@dataclass
class Model:
    langs: list[str]
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    gram: np.ndarray = None  # type: ignore[assignment]
    prefix: np.ndarray = None  # type: ignore[assignment]
    suffix: np.ndarray = None  # type: ignore[assignment]
    lex: np.ndarray = None  # type: ignore[assignment]
    first: np.ndarray = None  # type: ignore[assignment]
    move: np.ndarray = None  # type: ignore[assignment]
    known: np.ndarray = None  # type: ignore[assignment]  # which trigrams the training texts have
    floor: float = 0.0  # least share of known trigrams of a text in a trained language

    def tables(self) -> list[str]:
        return ["gram", "prefix", "suffix", "lex", "first", "move"]

    def lexicon_index(self, hashes: np.ndarray) -> np.ndarray:
        """1 + place in the lexicon, 0 outside it."""
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at + 1, 0)

    def emissions(self, w: Words) -> np.ndarray:
        """[languages, words]"""
        lex = self.lexicon_index(w.hashes)
        return np.stack([np.add.reduceat(self.gram[g][w.grams], w.gram_at) + self.prefix[g][w.prefix] + self.suffix[g][w.suffix] + self.lex[g][lex] for g in range(len(self.langs))])


def _cuts(model: Model, w: Words, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[languages, segments]: the forward state that enters each segment and the backward one that leaves it.

    A segment's matrix is the product of its words' steps; those of a line are
    chained, all lines at once.
    """
    k, n = len(model.langs), len(w.starts)
    m = np.exp(model.move).astype(np.float64)
    back = np.ascontiguousarray(m.T)
    enter, leave = np.repeat(np.exp(model.first.astype(np.float64))[:, None], n, 1), np.ones((k, n))
    cut = np.flatnonzero(w.goes_on | np.append(w.goes_on[1:], False))
    if not len(cut):
        return enter, leave
    order = cut[np.argsort(-w.lengths[cut], kind="stable")]
    lengths, starts = w.lengths[order], w.starts[order]
    product = np.zeros((k, k, len(order)))
    for t in range(int(lengths[0])):
        here = int(np.searchsorted(-lengths, -t, "left"))
        e = scores[:, starts[:here] + t].astype(np.float64)
        e = np.exp(e - e.max(0))
        x = np.tensordot(back, product[:, :, :here], 1) if t else np.repeat(np.eye(k)[:, :, None], here, 2)
        x = e[:, None] * x
        product[:, :, :here] = x / x.sum((0, 1))
    of = np.empty(n, np.int64)
    of[order] = np.arange(len(order))
    heads = cut[~w.goes_on[cut]]
    ends = np.append(heads[1:], cut[-1] + 1)
    # the last segment of each line: lines are runs of cut segments
    parts = np.array([np.searchsorted(cut, e) for e in ends]) - np.searchsorted(cut, heads)
    for step in range(1, int(parts.max())):
        now = heads[parts > step] + step
        x = np.einsum("ijn,jn->in", product[:, :, of[now - 1]], enter[:, now - 1])
        x = back @ x
        enter[:, now] = x / x.sum(0)
    for step in range(int(parts.max()) - 1, 0, -1):
        now = heads[parts > step] + step
        x = np.einsum("jin,jn->in", product[:, :, of[now]], leave[:, now])
        x = m @ x
        leave[:, now - 1] = x / x.sum(0)
    return enter, leave


def forward_backward(model: Model, w: Words, emissions: np.ndarray, expected: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """[languages, words] posteriors; expected transition counts where asked for.

    Words are laid out by their place in the segment, longest segments first,
    so each step of all segments is one contiguous slice.
    """
    order = np.argsort(-w.lengths, kind="stable")
    s, lengths = w.starts[order], w.lengths[order]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest + 1), "left")  # segments longer than t
    base = np.concatenate(([0], np.cumsum(active)))
    step = np.repeat(np.arange(longest), active[:longest])
    place = s[np.arange(len(step)) - base[step]] + step
    p = emissions[:, place]
    p = np.exp(p - p.max(0))
    m = np.exp(model.move)
    back = np.ascontiguousarray(m.T)
    alpha, beta = np.empty_like(p), np.empty_like(p)
    enter, leave = _cuts(model, w, emissions)
    a = enter[:, order].astype(p.dtype)
    ends = leave[:, order].astype(p.dtype)
    for t in range(longest):
        lo, n = base[t], active[t]
        a = (back @ a[:, :n] if t else a) * p[:, lo : lo + n]
        a /= a.sum(0)
        alpha[:, lo : lo + n] = a
    b = ends.copy()
    for t in range(longest - 1, -1, -1):
        n, lo = active[t + 1], base[t + 1]
        if n:
            x = b[:, :n] * p[:, lo : lo + n]
            x /= x.sum(0)
            b[:, :n] = m @ x
        beta[:, base[t] : base[t] + active[t]] = b[:, : active[t]]
    post = alpha * beta
    post /= post.sum(0)
    xi = None
    if expected:
        later = np.arange(base[1], len(place))
        earlier = base[step[later] - 1] + later - base[step[later]]
        x, y = alpha[:, earlier], p[:, later] * beta[:, later]
        xi = m * ((x / ((back @ x) * y).sum(0)) @ y.T)
    out = np.empty_like(post)
    out[:, place] = post
    return out, xi


def _coverage(known: np.ndarray, w: Words, texts: int) -> np.ndarray:
    """The share of each text's trigrams that are known; 0 without words."""
    owner = np.repeat(w.owner, np.diff(np.append(w.gram_at, len(w.grams))))
    return np.bincount(owner, known[w.grams], texts) / np.maximum(np.bincount(owner, minlength=texts), 1)


def _floor(texts: list[str], most: float = 0.65, slack: float = 0.8) -> float:
    """`slack` times the coverage that all but 5 % of texts have by trigrams of other texts, at most `most`."""
    halves = [h for h in (texts[::2], texts[1::2])]
    words = [words_of(h) for h in halves]
    found = []
    for mine, other, h in zip(words, words[::-1], halves):
        if mine is not None and other is not None:
            known = np.zeros(2 * GRAMS, bool)
            known[other.grams] = True
            found.append(_coverage(known, mine, len(h))[np.unique(mine.owner)])
    return min(most, slack * float(np.quantile(np.concatenate(found), 0.05))) if found else 0.3


def train(rows: list[tuple[str, str]], lexicon_size: int = 400, steps: int = 40, l2: float = 1e-4, seed: int = 11) -> Model:
    """Fit on (text, lang) rows by Adam on the conditional likelihood of code-switched splices."""
    rows = [(t, g) for t, g in rows if t and g is not None]
    langs = sorted({g for _, g in rows})
    rng = np.random.default_rng(seed)
    spans: list[tuple[str, int]] = []
    for text, g in rows:
        words = text.split()
        at = 0
        while at < len(words):
            n = int(rng.integers(4, 40))
            spans.append((" ".join(words[at : at + n]), langs.index(g)))
            at += n
    w = None
    if spans:
        # lines of spans in random order; the chain crosses spans, not lines
        order = rng.permutation(len(spans))
        texts, labels = [], []
        for k in range(0, len(order), 3):
            texts.append(" ".join(spans[q][0] for q in order[k : k + 3]))
        owner_span = [spans[q] for q in order]
        w = words_of(texts)
        counts = [words_of([s]) for s, _ in owner_span]
        labels = np.concatenate([np.full(len(c.owner), g) for c, (_, g) in zip(counts, owner_span) if c is not None] or [np.zeros(0, int)])
    if w is None:
        return Model([])
    k = len(langs)
    model = Model(langs, known=np.zeros(2 * GRAMS, bool), floor=_floor([t for t, _ in rows]))
    model.known[w.grams] = True
    found: set[int] = set()
    for g in range(k):
        values, n = np.unique(w.hashes[labels == g], return_counts=True)
        found.update(values[np.argsort(-n, kind="stable")[:lexicon_size]][: int((n > 1).sum())].tolist())
    model.lexicon = np.array(sorted(found), np.uint64)
    model.gram, model.prefix, model.suffix = (np.zeros((k, n), np.float32) for n in (2 * GRAMS, AFFIX, AFFIX))
    model.lex, model.first, model.move = np.zeros((k, len(model.lexicon) + 1), np.float32), np.zeros(k, np.float32), np.zeros((k, k), np.float32)
    lex = model.lexicon_index(w.hashes)
    letters = np.diff(np.append(w.gram_at, len(w.grams)))
    gold = np.zeros((k, len(labels)), np.float32)
    gold[labels, np.arange(len(labels))] = 1
    follows = np.ones(len(labels), bool)
    follows[w.starts] = False
    i = np.flatnonzero(follows)
    gold_moves = gold[:, i - 1] @ gold[:, i].T
    used = np.unique(w.grams)
    local = np.searchsorted(used, w.grams)
    moment = {name: (np.zeros_like(getattr(model, name)), np.zeros_like(getattr(model, name))) for name in model.tables()}
    for step in range(1, steps + 1):
        post, xi = forward_backward(model, w, model.emissions(w), expected=True)
        off = (post - gold) / len(labels)
        add = lambda at, size, x: np.stack([np.bincount(at, row, size) for row in x])
        grams = np.zeros_like(model.gram)
        grams[:, used] = add(local, len(used), np.repeat(off, letters, axis=1))
        grads = {"gram": grams, "prefix": add(w.prefix, AFFIX, off), "suffix": add(w.suffix, AFFIX, off), "lex": add(lex, len(model.lexicon) + 1, off), "first": off[:, w.starts].sum(1), "move": (xi - gold_moves) / len(labels)}
        for name, g in grads.items():
            x = getattr(model, name)
            g = g + l2 * x / 100
            m1, m2 = moment[name]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x -= (0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def label_words(model: Model, texts: list[str | None]) -> Iterator[tuple[int, int, Words | None, np.ndarray, np.ndarray]]:
    """(first text, texts, words, label index, posterior) for runs of the texts."""
    for first, part in textvec.chunks(texts, 500_000):
        w = words_of(part) if model.langs else None
        if w is None:
            yield first, len(part), None, np.zeros(0, int), np.zeros(0)
            continue
        post, _ = forward_backward(model, w, model.emissions(w))
        best = post.argmax(0)
        yield first, len(part), w, best, post.max(0)


def label_texts(model: Model, texts: list[str | None]) -> pa.StructArray:
    """A RESULT struct for each text."""
    n, k = len(texts), max(1, len(model.langs))
    counts, conf, cover = np.zeros((n, k), np.int64), np.zeros(n), np.zeros(n)
    span_doc, span_lang, span_start, span_n = [], [], [], []
    for first, size, w, best, posterior in label_words(model, texts):
        if w is None:
            continue
        counts[first : first + size] = np.bincount(w.owner * k + best, minlength=size * k).reshape(size, k)
        conf[first : first + size] = np.bincount(w.owner, posterior, size)
        cover[first : first + size] = _coverage(model.known, w, size)
        new = np.flatnonzero(np.concatenate(([True], (w.owner[1:] != w.owner[:-1]) | (best[1:] != best[:-1]))))
        begins = np.searchsorted(w.owner, np.arange(size))
        span_doc.append(w.owner[new] + first)
        span_lang.append(best[new])
        span_start.append(new - begins[w.owner[new]])
        span_n.append(np.diff(np.append(new, len(best))))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    doc = cat(span_doc)
    offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    total = counts.sum(1)
    top = counts.argmax(1)
    some = np.maximum(total, 1)
    names = np.array([*model.langs, ""], object)
    label = pa.array(names[np.where(total > 0, top, -1)], pa.string(), mask=total == 0)
    as_list = lambda values: pa.ListArray.from_arrays(offsets, values)
    arrays = [
        label, pa.array(counts.max(1) / some), pa.array(conf / some), pa.array(total.astype(np.int32)),
        as_list(pa.array(names[cat(span_lang).astype(int)], pa.string())), as_list(pa.array(cat(span_start).astype(np.int32))), as_list(pa.array(cat(span_n).astype(np.int32))),
        pa.array(cover >= model.floor),
    ]
    return pa.StructArray.from_arrays(arrays, [f.name for f in RESULT.fields])


def fit(docs: DataFrame, train_docs: int = 64) -> Model:
    """Train on at most `train_docs` documents of each lang, chosen by hash of doc_id."""
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = subset(docs, "doc_id", "lang").filter("lang is not null and doc_id is not null").select("doc_id", "lang", order_hash(F.col("doc_id"), "langid").alias("h")).distinct()
    chosen = ids.withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= train_docs).select("doc_id").distinct()
    wanted = sorted(r[0] for r in chosen.collect())  # at most train_docs for each language
    rows = subset(docs, "doc_id", "text", "lang").filter(F.col("doc_id").isin(wanted) & F.col("lang").isNotNull() & F.col("text").isNotNull()).distinct().collect() if wanted else []
    return train([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang, r.text))])


def labels(text: Column, model: Model) -> Column:
    """The RESULT struct of a text column."""

    @F.arrow_udf(RESULT)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield label_texts(model, texts.to_pylist())

    return label(text)


def accepted(result: Column, min_share: float) -> Column:
    return (result["n_words"] > 0) & (result["share"] >= min_share) & result["recognised"]


def identify(docs: DataFrame, train_docs: int = 64, min_share: float = 0.4) -> DataFrame:
    """doc_id, the RESULT columns and `accepted`, a row for each document."""
    model = fit(docs, train_docs)
    found = subset(docs, "doc_id", "text").select("doc_id", labels(F.col("text"), model).alias("r"))
    return found.select("doc_id", "r.*", accepted(F.col("r"), min_share).alias("accepted")).drop("recognised")


def keep_identified(docs: DataFrame, train_docs: int = 64, min_share: float = 0.4) -> DataFrame:
    """The rows of the accepted documents, all columns as they were."""
    names = docs.columns
    model = fit(docs, train_docs)
    every = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), labels(F.col("text"), model).alias("r"))
    return every.filter(accepted(F.col("r"), min_share)).select("row.*")
