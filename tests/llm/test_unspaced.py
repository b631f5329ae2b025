"""Scripts written without spaces, and punctuation beyond U+3000."""

import random

import numpy as np
import pytest

from lignum.llm import simhash, textvec

SCRIPTS = {"zh": (0x4E00, 0x5E00), "ja": (0x3041, 0x3096), "th": (0xE01, 0xE2E)}


def paragraph(script, seed, n=600):
    rng = random.Random(seed)
    a, b = SCRIPTS[script]
    return "".join(chr(rng.randrange(a, b)) if k % 20 else "。" for k in range(1, n + 1))


def distance(a, b):
    fp, _ = simhash.fingerprints([a, b])
    return int(np.bitwise_count(fp[0] ^ fp[1]).sum())


@pytest.mark.parametrize("script", SCRIPTS)
def test_one_changed_character_stays_near(script):
    a = paragraph(script, 1).replace("。", "")
    b = a[:300] + chr(ord(a[300]) ^ 1) + a[301:]
    assert a != b and distance(a, b) <= 40 < distance(a, paragraph(script, 2))


def test_near_copies_are_found(spark):
    rows = [(k, paragraph("zh", k)) for k in range(1, 6)]
    rows += [(10 + k, t.replace(t[100], "甲", 1)) for k, t in rows]
    got = {r.doc_id_b: r.doc_id_a for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10 + k: k for k in range(1, 6)}


def test_words():
    def words(text):
        cps, _ = textvec.codepoints([text])
        return ["".join(map(chr, cps[a:b])) for a, b in zip(*textvec.word_spans(cps))]

    assert words("one two　three, （four） \U0001f600 한국어 да") == ["one", "two", "three", "four", "한국어", "да"]
    assert words("abc漢字、一二三四。x") == ["abc", "漢字", "一二三", "二三四", "x"]
    _, has = simhash.fingerprints(["。、！", "\U0001f600"])
    assert not has.any()
