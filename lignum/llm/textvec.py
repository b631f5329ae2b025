"""Vectorised text primitives: whole batches become numpy arrays.

All functions take lists of strings (None counts as empty) and loop over
characters only inside numpy, so a batch costs nanoseconds a character.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

_LIMIT = 0x33000  # no letters or digits beyond
#: scripts written without spaces: Thai to Tibetan, Myanmar, Khmer, Tai, kana, bopomofo, Han
UNSPACED = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, _LIMIT - 1))
GRAM = 3
#: 1: a character of words, 2: of a script without spaces, where marks belong to it too
_WORD = np.zeros(_LIMIT + 1, np.int8)
_WORD[:_LIMIT] = [chr(c).isalnum() for c in range(_LIMIT)]
for _a, _b in UNSPACED:
    _WORD[_a : _b + 1] = [2 * (unicodedata.category(chr(c))[0] in "LMN") for c in range(_a, _b + 1)]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) runs of about `chars` characters; a longer text is a run of its own."""
    run: list[str] = []
    first = size = 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > chars:
            yield first, run
            run, first, size = [], i, 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and the start of each text."""
    joined = "\n".join(texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return cps, np.concatenate(([0], np.cumsum(lengths)[:-1]))


def word_mask(cps: np.ndarray) -> np.ndarray:
    return _WORD[np.minimum(cps, _LIMIT)] > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[0::2], edges[1::2]


def word_spans(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a run of a script without spaces gives its n-grams of GRAM characters, a shorter one itself."""
    kind = _WORD[np.minimum(cps, _LIMIT)]
    starts, ends = runs(kind == 1)
    if (kind == 2).any():
        first, last = runs(kind == 2)
        n = np.maximum(1, last - first - GRAM + 1)
        at = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        starts, ends = np.concatenate((starts, at)), np.concatenate((ends, np.minimum(at + GRAM, np.repeat(last, n))))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    return starts, ends


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each lower-cased alphanumeric word, and the index of its text."""
    lowered = [t.lower() for t in texts]
    cps, begins = codepoints(lowered)
    starts, ends = word_spans(cps)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = ends - starts
    power = np.cumprod(np.full(int(n.max()), _BASE, np.uint64))
    inside = np.repeat(starts, n)
    base = np.concatenate(([0], np.cumsum(n)[:-1]))
    pos = np.arange(int(n.sum())) - np.repeat(base, n)
    terms = (cps[inside + pos].astype(np.uint64) + np.uint64(1)) * power[pos]
    owner = np.searchsorted(begins, starts, "right") - 1
    return mix(np.add.reduceat(terms, base)), owner
