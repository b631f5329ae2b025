"""Transcript parsing: a hidden Markov model recovers the roles of a plain-text chat.

A transcript is lines. The states are (role, how many lines of the turn came
before, up to `DEPTH`), so the lengths of turns are learned too. A line's
features are its speaker marker, its length and whether it ends like a question,
independent of each other given the state. A marker is recognised by its shape
(a name before a colon, in brackets, as a heading, in bold), not by a list; what
its name says about the role is learned from labelled transcripts (a bounded
sample, `train_conversations` by hash of conv_id), which some common names
support with prior counts. Start, transition and feature probabilities are
smoothed counts. Viterbi gives the likeliest states, turns are cut where a first
line begins, and each turn is rendered as <|role|>, its text without the marker,
and <|end|>. The roles are those of the labelled sample, whatever they are called.

Defined cases: a null or empty transcript has no turns and renders as ''; blank
lines belong to the turn around them; a null text of a turn is an empty line;
rows with a null role train nothing; without a labelled row the roles are the
usual ones; a null conv_id is a conversation of its own; turns with the same
number are in order of role and text, and repeated rows repeat; a line inside a
turn that looks like a marker keeps it; a marker of a name that is neither known
nor repeated in the transcript stays in the text; marker-like text renders with
its markers broken, so that a rendering has no markers but its own; very long
lines are lines; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import order_hash, subset

ROLES = ("assistant", "system", "user")
#: Names by which transcripts often mark a role: prior counts, not rules.
SEEDS = {
    "system": ("system", "instructions", "instruction", "context"),
    "user": ("user", "human", "q", "question", "customer", "client", "student", "patient", "prompter", "me"),
    "assistant": ("assistant", "ai", "a", "answer", "bot", "agent", "chatbot", "model", "support", "response"),
    "tool": ("tool", "function", "observation", "tool result"),
}
DEPTH, SIZES = 8, 10
_NAME = r"[^\W\d_](?:[^\W_]|[.'](?=\w)){0,30}(?: [^\W_]{1,20}){0,2}"
_MARK = re.compile(
    rf"\s*(?:[#*_>\s]*(?P<a>{_NAME})\s*[*_]*\s*[:：][*_]*(?!//)|\*\*(?P<b>{_NAME})\*\*|(?:\[\s*(?P<c>{_NAME})\s*\]|\(\s*(?P<d>{_NAME})\s*\)|<\|?\s*(?P<e>{_NAME})\s*\|?>)[*_]*:?|#{{1,6}}\s*(?P<f>{_NAME})\s*$|(?P<g>{_NAME})\s?>)\s?"
)
RESULT = T.StructType([T.StructField("n_turns", T.IntegerType()), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("rendered", T.StringType())])


def marker(line: str) -> tuple[str, int] | None:
    """(name in small letters, end of the marker) of a line that begins like a turn."""
    m = _MARK.match(line)
    return None if m is None else (m[m.lastgroup].lower(), m.end())


def length(line: str) -> int:
    """0 for a blank line, then by half-octaves from 16 characters."""
    n = len(line.strip())
    return 0 if not n else 1 + min(SIZES - 2, max(0, int(2 * np.log2(n / 16)))) if n >= 16 else 1


@dataclass
class Hmm:
    """Log-probabilities. A state is role * DEPTH + lines before; names has a row for each known name, then unknown and none."""

    roles: list[str]
    start: np.ndarray
    move: np.ndarray
    names: dict[str, int]
    name: np.ndarray  # [name, state]
    size: np.ndarray  # [length, state]
    asks: np.ndarray  # [question, state]

    def emission(self, line: str, known: set[str] | None = None) -> np.ndarray:
        m = marker(line)
        if m is None:
            row = len(self.names) + 1
        else:
            row = self.names.get(m[0], len(self.names))
            if row == len(self.names) and (known is None or m[0] not in known):
                row += 1  # a name of prose
        return self.name[row] + self.size[length(line)] + self.asks[int(line.rstrip().endswith(("?", "？")))]


def repeated(lines: list[str]) -> set[str]:
    """Names that mark several lines of a transcript."""
    found = Counter(m[0] for x in lines if (m := marker(x)))
    return {n for n, k in found.items() if k > 1}


def train(transcripts: list[tuple[list[str | None], list[str | None]]]) -> Hmm:
    """From (texts as marked, roles) of whole conversations."""
    roles = sorted({r for _, rs in transcripts for r in rs if r is not None}) or list(ROLES)
    n = len(roles) * DEPTH
    at = {r: k * DEPTH for k, r in enumerate(roles)}
    named: dict[str, Counter[str]] = defaultdict(Counter)
    start, move = np.zeros(n), np.zeros((n, n))
    for r in roles:
        start[at[r]] = 0.5
        for k in range(DEPTH):
            # a turn goes on, or any role begins one
            move[at[r] + k, at[r] + min(k + 1, DEPTH - 1)] = 0.5
            for q in roles:
                move[at[r] + k, at[q]] = 0.05
    size, asks = np.full((SIZES, n), 0.3), np.full((2, n), 0.5)
    bare, strange = np.full(n, 0.5), np.full(n, 0.1)
    for k in range(0, n, DEPTH):
        strange[k] = 0.5
    for texts, rs in transcripts:
        before = None
        lines = "\n".join(t or "" for t in texts).split("\n")
        known = repeated(lines)
        for text, role in zip(texts, rs):
            if role is None:
                before = None
                continue
            for k, line in enumerate((text or "").split("\n")):
                s = at[role] + min(k, DEPTH - 1)
                if before is None:
                    start[s] += k == 0
                else:
                    move[before, s] += 1
                size[length(line), s] += 1
                asks[int(line.rstrip().endswith(("?", "？"))), s] += 1
                m = marker(line)
                if m and not k:
                    named[m[0]][role] += 1
                elif m and m[0] in known:
                    strange[s] += 1
                else:
                    bare[s] += 1
                before = s
    # of a name that marked a first line twice, or is a usual one, the roles are known
    usual = {x: r for r, xs in SEEDS.items() for x in xs if r in at} | {r.lower(): r for r in roles}
    names = {x: k for k, x in enumerate(sorted({x for x, c in named.items() if sum(c.values()) > 1} | set(usual)))}
    name = np.full((len(names) + 2, n), 1e-3)
    for x, row in names.items():
        for r in roles:
            name[row, at[r]] += named[x][r] + 2.0 * (usual.get(x) == r)
    name[len(names)] += strange
    name[len(names) + 1] += bare
    with np.errstate(divide="ignore"):
        log = lambda x, axis: np.log(x / x.sum(axis, keepdims=True))
        return Hmm(roles, log(start, 0), log(move, 1), names, log(name, 0), log(size, 0), log(asks, 0))


def viterbi(start: np.ndarray, move: np.ndarray, emissions: np.ndarray) -> list[int]:
    """The likeliest states for [step, state] log-probabilities of what is seen."""
    score = start + emissions[0]
    back = []
    for e in emissions[1:]:
        paths = score[:, None] + move
        best = paths.argmax(0)
        back.append(best)
        score = paths[best, np.arange(len(start))] + e
    at = int(score.argmax())
    states = [at]
    for best in reversed(back):
        at = int(best[at])
        states.append(at)
    return states[::-1]


def states_of(hmm: Hmm, lines: list[str]) -> list[tuple[str, bool]]:
    """(role, whether a turn begins) of each line."""
    known = repeated(lines)
    path = viterbi(hmm.start, hmm.move, np.stack([hmm.emission(x, known) for x in lines]))
    return [(hmm.roles[s // DEPTH], s % DEPTH == 0) for s in path]


def parse(hmm: Hmm, transcript: str | None) -> list[tuple[str, str]]:
    """(role, text) turns."""
    if not transcript:
        return []
    lines = transcript.split("\n")
    known = repeated(lines)
    turns: list[tuple[str, list[str]]] = []
    for line, (role, first) in zip(lines, states_of(hmm, lines)):
        if first or not turns:
            m = marker(line)
            turns.append((role, [line[m[1] :] if m and (m[0] in hmm.names or m[0] in known) else line]))
        else:
            turns[-1][1].append(line)
    return [(r, "\n".join(x)) for r, x in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text.replace('<|', '< |')}\n<|end|>\n" for role, text in turns)


#: how the made-up transcripts mark system, user and assistant
STYLES = (("System: ", "User: ", "Assistant: "), ("**Instructions:** ", "**Human:** ", "**AI:** "), ("SYSTEM: ", "Q: ", "A: "), ("[Context] ", "[Customer] ", "[Agent] "), ("### System: ", "### User: ", "### Bot: "), ("<|system|>", "<|user|>", "<|assistant|>"))


def _marked() -> Column:
    """A turn as transcripts show it: names and marks vary by conversation, and a sixth of the later turns has none."""
    style = F.pmod(order_hash(F.col("conv_id"), "style"), F.lit(len(STYLES)))
    name = F.lit("")
    for k, role in enumerate(("system", "user", "assistant")):
        name = F.when(F.col("role") == role, F.element_at(F.array(*[F.lit(s[k]) for s in STYLES]), (style + 1).cast("int"))).otherwise(name)
    name = F.when(F.col("role").isNotNull() & (name == ""), F.concat(F.initcap("role"), F.lit(": "))).otherwise(name)
    bare = (F.pmod(order_hash(F.concat_ws("/", "conv_id", "turn"), "bare"), F.lit(6)) == 0) & (F.col("turn") > 0)
    return F.concat(F.when(bare, F.lit("")).otherwise(name), F.coalesce("text", F.lit("")))


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, transcript): turns are structs of turn, role and the text as marked."""
    rows = subset(conversations, "conv_id", "turn", "role", "text").withColumn("marked", _marked())
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "marked"))).alias("turns"))
    return whole.withColumn("transcript", F.array_join("turns.marked", "\n"))


def fit(conversations: DataFrame, train_conversations: int = 2000) -> Hmm:
    ids = subset(conversations, "conv_id").filter("conv_id is not null").distinct().orderBy(order_hash(F.col("conv_id"), "hmm"), "conv_id").limit(train_conversations)
    sample = transcripts(conversations.join(ids, "conv_id", "left_semi")).select("conv_id", "turns").collect()  # bounded by the parameter
    return train([([t.marked for t in r.turns], [t.role for t in r.turns]) for r in sorted(sample, key=lambda r: r.conv_id)])


def parsed(transcript: Column, hmm: Hmm) -> Column:
    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            turns = [parse(hmm, t) for t in column.to_pylist()]
            yield pa.array([{"n_turns": len(t), "roles": [r for r, _ in t], "rendered": render(t)} for t in turns], pa.struct([("n_turns", pa.int32()), ("roles", pa.list_(pa.string())), ("rendered", pa.string())]))

    return run(transcript)


def format_chats(conversations: DataFrame, train_conversations: int = 2000) -> DataFrame:
    """conv_id with the turns recovered from its transcript: n_turns, roles, rendered."""
    hmm = fit(conversations, train_conversations)
    return transcripts(conversations).select("conv_id", parsed(F.col("transcript"), hmm).alias("r")).select("conv_id", "r.*")
