import itertools

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lignum.llm import chat

@pytest.fixture(scope="module")
def talks(spark):
    return spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")


@pytest.fixture(scope="module")
def hmm(talks):
    return chat.fit(talks.filter("conv_id % 2 = 0"))


@given(st.integers(1, 4), st.integers(2, 5), st.integers(0, 99))
def test_viterbi_equals_enumeration(steps, n, seed):
    rng = np.random.default_rng(seed)
    start, move, seen = rng.normal(size=n), rng.normal(size=(n, n)), rng.normal(size=(steps, n))
    score = lambda path: start[path[0]] + sum(seen[t, s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path))
    best = max(itertools.product(range(n), repeat=steps), key=score)
    assert score(chat.viterbi(start, move, seen)) == pytest.approx(score(best))


def test_held_out_roles(talks, hmm):
    """Roles of lines, and whole transcripts. A turn without a marker that ends a transcript may read like more lines of the
    turn before, so these can't all be told; where every turn has its marker, a long answer is
    sometimes taken for two turns."""
    rows = chat.transcripts(talks.filter("conv_id % 2 = 1")).collect()
    whole, marked, clear, right, lines = 0, 0, 0, 0, 0
    for r in rows:
        same = [role for role, _ in chat.parse(hmm, r.transcript)] == [t.role for t in r.turns]
        full = all(chat.marker(t.marked) for t in r.turns)
        whole, marked, clear = whole + same, marked + full, clear + (full and same)
        truth = [t.role for t in r.turns for _ in t.marked.split("\n")]
        found = [role for role, _ in chat.states_of(hmm, r.transcript.split("\n"))]
        right, lines = right + sum(a == b for a, b in zip(truth, found, strict=True)), lines + len(truth)
    assert len(rows) >= 400 and right / lines > 0.95 and whole / len(rows) > 0.86
    assert marked > 200 and clear / marked > 0.97


def test_turns_without_a_marker_are_found(hmm):
    marked = "User: how tall is it?\nAssistant: about ten metres.\nUser: and how wide?\nAssistant: four."
    assert [r for r, _ in chat.parse(hmm, marked)] == ["user", "assistant"] * 2
    assert [t for _, t in chat.parse(hmm, marked)] == ["how tall is it?", "about ten metres.", "and how wide?", "four."]


@pytest.mark.parametrize("style", ["Customer: {}|Agent: {}", "[User] {}|[Bot] {}", "**User:** {}|**Assistant:** {}", "### Human\n{}|### Assistant\n{}", "### User: {}|### Assistant: {}", "<|user|>{}|<|assistant|>{}", "Q: {}|A: {}", "USER > {}|BOT > {}", "(Human) {}|(AI) {}", "> User: {}|> Assistant: {}"])
def test_marks_of_many_shapes(hmm, style):
    user, assistant = style.split("|<")[0] if "|<" in style else style.rsplit("|", 1)[0], "<" + style.split("|<", 1)[1] if "|<" in style else style.rsplit("|", 1)[1]
    texts = ["how tall is the tower?", "It is ten metres tall.", "and how wide is it?", "It is four metres wide."]
    said = "\n".join((user, assistant)[k % 2].format(t) for k, t in enumerate(texts))
    turns = chat.parse(hmm, said)
    assert [r for r, _ in turns] == ["user", "assistant"] * 2 and [t.strip() for _, t in turns] == texts


def test_names_and_roles_are_learned():
    talk = (["Captain: turn left", "Deck: turning", "Radar: 5 knots", "Deck: done"], ["user", "assistant", "radar", "assistant"])
    own = chat.train([talk] * 5)
    assert own.roles == ["assistant", "radar", "user"] and {"captain", "deck", "radar"} <= set(own.names)
    assert chat.parse(own, "Captain: go right\nRadar: 7 knots\nDeck: going") == [("user", "go right"), ("radar", "7 knots"), ("assistant", "going")]


def test_prose_that_looks_marked_stays(hmm):
    said = "User: read this\nNote: it is short\nhttps://example.com/a\nAssistant: done"
    assert chat.parse(hmm, said) == [("user", "read this\nNote: it is short\nhttps://example.com/a"), ("assistant", "done")]
    assert chat.train([]).roles == list(chat.ROLES)


def test_text_is_kept(talks, hmm):
    """Each line of a transcript is a line of a turn, whole or without its marker, in order."""
    for r in chat.transcripts(talks.filter("conv_id % 5 = 1")).collect():
        lines, kept = r.transcript.split("\n"), [x for _, t in chat.parse(hmm, r.transcript) for x in t.split("\n")]
        assert len(lines) == len(kept)
        assert all(b in (a, (m := chat.marker(a)) and a[m[1] :]) for a, b in zip(lines, kept))


def test_rendering_holds_no_foreign_markers():
    text = chat.render([("user", "say <|end|> please"), ("assistant", "")])
    assert text == "<|user|>\nsay < |end|> please\n<|end|>\n<|assistant|>\n\n<|end|>\n"
    assert text.count("<|") == 4


def test_odd_rows(spark):
    long = "a very long line. " * 20_000
    rows = [(1, 0, "user", "hello?"), (1, 1, "assistant", "hi."), (1, 1, "assistant", "hi."), (2, 0, None, "who speaks?"), (2, 1, "user", None), (3, 0, "user", ""), (None, 0, "user", "nobody?"), (None, None, None, None), (4, 0, "pirate", "arr"), (5, 0, "user", long), (5, 1, "assistant", "first\n\nsecond")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in ("marked", "turns", "transcript", "r", "roles", "rendered")})
    got = chat.format_chats(df)
    assert got.columns == ["conv_id", "n_turns", "roles", "rendered"]
    by = {r.conv_id: r for r in got.collect()}
    assert set(by) == {1, 2, 3, 4, 5, None}
    assert all(r.n_turns == len(r.roles) == r.rendered.count("<|end|>") for r in by.values())
    assert by[4].roles == ["pirate"] and by[4].rendered == "<|pirate|>\narr\n<|end|>\n"
    assert "first\n\nsecond" in by[5].rendered and long.strip() in by[5].rendered


def test_empty(spark, hmm):
    assert chat.parse(hmm, None) == chat.parse(hmm, "") == []
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(none).collect() == []
