"""Chat formatting: roles of a messy transcript by a hidden Markov model, then canonical turns.

States are (role, first line of a turn or a later one).  A line is seen as a few categorical
features: the speaker marker at its start, its length class, its last sign and its case.  Counts
over labelled transcripts give start, transition and emission probabilities; Viterbi finds the
best state sequence, and runs of one turn are rendered as ``<|role|>\\ntext\\n<|end|>\\n``.  A marker
is cut where a turn opens and nowhere else, with one space behind it; the rest of a text stays as
it is.

``parse`` decodes raw transcripts.  A conversation that a table holds as turns may be too long for
one row, so ``transcripts`` deals it out in segments of ``SEGMENT`` turns, each with the ``CONTEXT``
turns on both sides: these are decoded along, so that the states at a segment's ends follow from
what surrounds them, but belong to the neighbours.  A turn that goes on in the next segment is
joined again, and positions count through the conversation.

Counting is a map with sums of a hundred numbers, so it runs over all labelled segments and gathers
no text.

Defined results: null or empty transcripts give no turn; null roles count as "user" when written
raw and null texts as empty; exact repeats of a turn row count once; several texts of one turn come
in the order of role and text; a row whose conversation or turn number is null is a transcript of
its own, told apart by ``lone`` (a hash of the row, null for all others); other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Scratch

ROLES = ("system", "user", "assistant")
SEGMENT, CONTEXT = 256, 64
#: Segments of a conversation whose turns are counted on before those of the next so many.
BLOCK = 1024
#: Names that speaker markers use, by role.
NAMES = {
    "system": ("system", "instruction", "context", "setup"),
    "user": ("user", "human", "q", "question", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "agent", "model"),
}
#: Marker styles of raw transcripts (before and after the name; names by role).
STYLES = (("", ": ", ("System", "User", "Assistant")), ("", ": ", ("Context", "Q", "A")), ("", ">> ", ("setup", "human", "bot")), ("[", "] ", ("SYSTEM", "USER", "AI")), ("**", ":** ", ("System", "Human", "Assistant")))

#: Share of the even distribution in every probability.
EVEN = 0.01

_role_of = {n: r for r, names in NAMES.items() for n in names}
_MARKER = re.compile(r"^\s*[\[<(*#]*\s*(" + "|".join(sorted(_role_of, key=len, reverse=True)) + r")\s*(?:[\])>*]*\s*[:>]+[*>]*|\]) ?", re.IGNORECASE)
_WIDTHS = (4, 5, 3, 3)  # values of each feature
_STATES = 2 * len(ROLES)


def features(lines: Sequence[str]) -> tuple[np.ndarray, list[int]]:
    """Feature values (lines x features), and where each line's content begins."""
    out, begins = np.zeros((len(lines), len(_WIDTHS)), np.int64), []
    for t, line in enumerate(lines):
        m = _MARKER.match(line)
        marker = 0 if m is None else 1 + ROLES.index(_role_of[m[1].lower()])
        begins.append(m.end() if m else 0)
        rest = line[begins[-1] :].strip()
        size = sum(len(rest) > b for b in (0, 60, 150, 350))
        end = 0 if not rest else 1 if rest[-1] in "?¿" else 2
        case = 0 if not rest else 1 if rest[0].isupper() else 2
        out[t] = marker, size, end, case
    return out, begins


@dataclass
class Model:
    """Log probabilities; state 2 r is role r's first line, 2 r + 1 a later one."""

    start: np.ndarray
    move: np.ndarray
    see: list[np.ndarray]


def tally(labelled: Sequence[tuple[Sequence[str], Sequence[int]]]) -> np.ndarray:
    """Counts of starts, moves and features in (lines, states), on end."""
    start, move, see = np.zeros(_STATES), np.zeros((_STATES, _STATES)), [np.zeros((_STATES, w)) for w in _WIDTHS]
    for lines, states in labelled:
        seen, s = features(lines)[0], np.asarray(states)
        if len(s):
            start[s[0]] += 1
            np.add.at(move, (s[:-1], s[1:]), 1)
            for k, table in enumerate(see):
                np.add.at(table, (s, seen[:, k]), 1)
    return np.concatenate([start, move.ravel(), *[t.ravel() for t in see]])


def model_of(counts: np.ndarray) -> Model:
    """Probabilities of a ``tally``: shares, mixed with a little of the even distribution, so that
    what was never seen is equally unlikely in frequent and in rare states.  A later line follows
    its own turn, and no transcript starts with one."""
    edges = np.cumsum([_STATES, _STATES**2, *[_STATES * w for w in _WIDTHS]])
    start, move, *see = np.split(np.asarray(counts, float), edges[:-1])
    move, see = move.reshape(_STATES, _STATES), [t.reshape(_STATES, w) for t, w in zip(see, _WIDTHS, strict=True)]

    def shares(a: np.ndarray) -> np.ndarray:
        total, even = a.sum(-1, keepdims=True), 1 / a.shape[-1]
        return (1 - EVEN) * np.where(total > 0, a / np.maximum(total, 1), even) + EVEN * even

    start, move = shares(start), shares(move)
    for to in range(1, _STATES, 2):
        for of in range(_STATES):
            if of // 2 != to // 2:
                move[of, to] = 1e-9
        start[to] = 1e-9
    log = lambda a: np.log(a / a.sum(-1, keepdims=True))
    return Model(log(start), log(move), [np.log(shares(t)) for t in see])


def fit(labelled: Sequence[tuple[Sequence[str], Sequence[int]]]) -> Model:
    """A model of (lines, states)."""
    return model_of(tally(labelled))


def viterbi(model: Model, seen: np.ndarray) -> np.ndarray:
    """The most probable states."""
    if not len(seen):
        return np.zeros(0, np.int64)
    emit = sum(table[:, seen[:, k]] for k, table in enumerate(model.see)).T
    best, back = model.start + emit[0], np.zeros((len(seen), len(model.start)), np.int64)
    for t in range(1, len(seen)):
        ways = best[:, None] + model.move
        back[t] = ways.argmax(0)
        best = ways.max(0) + emit[t]
    out = np.empty(len(seen), np.int64)
    out[-1] = best.argmax()
    for t in range(len(seen) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def pieces_of(model: Model, own: str | None, before: str | None = None, after: str | None = None) -> list[tuple[bool, str, str]]:
    """(opens, role, text) of the turns of a raw transcript, decoded with what surrounds it.  Only
    the first piece can go on from what lies before (opens is then false)."""
    if not own:
        return []
    lines, early = own.split("\n"), before.split("\n") if before else []
    every = early + lines + (after.split("\n") if after else [])
    seen, begins = features(every)
    states = viterbi(model, seen)[len(early) : len(early) + len(lines)]
    out: list[tuple[bool, str, list[str]]] = []
    for line, begin, state in zip(lines, begins[len(early) :], states, strict=False):
        opens = state % 2 == 0
        if opens or not out:
            out.append((opens or not early, ROLES[state // 2], []))
        out[-1][2].append(line[begin:] if opens else line)
    return [(opens, role, "\n".join(text)) for opens, role, text in out]


def turns_of(model: Model, transcript: str | None) -> list[tuple[str, str]]:
    """(role, text) of the turns of a whole raw transcript."""
    return [(role, text) for _, role, text in pieces_of(model, transcript)]


def render(role: str, text: str) -> str:
    """One turn in the canonical form."""
    return f"<|{role}|>\n{text}\n<|end|>\n"


def raw_line(conv: object, number: object, role: str | None, text: str | None) -> str:
    """A turn as it stands in a raw transcript: the marker style goes by conversation, and some
    turns after the first have lost their marker."""
    key = hash_of(conv)
    before, after, names = STYLES[key % len(STYLES)]
    if number and hash_of(f"{conv}:{number}") % 12 == 0:
        return text or ""
    name = names[ROLES.index(role)] if role in ROLES else names[1]
    return f"{before}{name}{after}{text or ''}"


def hash_of(x: object) -> int:
    return zlib.crc32(str(x).encode())


def transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, context: int = CONTEXT) -> DataFrame:
    """(conv_id, lone, segment, turns): the turns of each segment in order, as an array of structs
    whose ``side`` is 0 for its own turns, -1 and 1 for the context before and after."""
    own = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    ).distinct()
    lone = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), F.xxhash64("conv_id", "turn", "role", "text"))
    number = F.coalesce(F.floor(F.col("turn") / segment).cast("long"), F.lit(0).cast("long"))
    place = lambda s, side: F.struct(s.alias("segment"), F.lit(side).alias("side"))
    inside = F.col("turn") - number * segment
    places = F.array(
        place(number, 0), F.when(lone.isNull() & (inside >= segment - context), place(number + 1, -1)), F.when(lone.isNull() & (inside < context), place(number - 1, 1))
    )
    dealt = own.select("conv_id", lone.alias("lone"), F.explode(F.filter(places, lambda p: p.isNotNull())).alias("at"), "turn", "role", "text")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text", F.col("at.side").alias("side"))))
    out = dealt.groupBy("conv_id", "lone", F.col("at.segment").alias("segment")).agg(listed.alias("turns"))
    return out.where(F.exists("turns", lambda t: t["side"] == 0))


def raw(segments: DataFrame) -> DataFrame:
    """(conv_id, lone, segment, before, transcript, after): segments written as raw transcripts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sides: dict[int, list[str]] = {-1: [], 0: [], 1: []}
            for conv, turns in zip(f["conv_id"], f["turns"], strict=True):
                for side, out in sides.items():
                    out.append("\n".join(raw_line(conv, t["turn"], t["role"], t["text"]) for t in turns if t["side"] == side))
            yield f[["conv_id", "lone", "segment"]].assign(before=sides[-1], transcript=sides[0], after=sides[1])

    kind = segments.schema["conv_id"].dataType.simpleString()
    return segments.mapInPandas(run, f"conv_id {kind}, lone long, segment long, before string, transcript string, after string")


def train(segments: DataFrame) -> Model:
    """A model of all ``segments``, written raw: each task sends its counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(tally([])))
        for f in frames:
            labelled = []
            for conv, turns in zip(f["conv_id"], f["turns"], strict=True):
                lines: list[str] = []
                states: list[int] = []
                for t in turns:
                    if t["side"] == 0:
                        own = raw_line(conv, t["turn"], t["role"], t["text"]).split("\n")
                        role = ROLES.index(t["role"]) if t["role"] in ROLES else 1
                        lines += own
                        states += [2 * role] + [2 * role + 1] * (len(own) - 1)
                labelled.append((lines, states))
            total += tally(labelled)
        yield pd.DataFrame({"cell": np.arange(len(total)), "n": total})

    counts = np.zeros(len(tally([])))
    for r in segments.select("conv_id", "turns").mapInPandas(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    return model_of(counts)


def _parser(model: Model) -> Callable:
    columns = ["conv_id", "lone", "segment", "nth", "last", "opens", "role", "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for conv, lone, segment, before, own, after in f.itertuples(index=False):
                pieces = pieces_of(model, own, before, after)
                out += [(conv, lone, segment, n, n == len(pieces) - 1, *piece) for n, piece in enumerate(pieces)]
            yield pd.DataFrame(out, columns=columns)

    return run


def _same(*columns: str) -> Column:
    """Null-safe equality of each column with the one of its name and an underscore."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return out


def _opened_before(pieces: DataFrame) -> DataFrame:
    """(conv_id, lone, segment, ahead): turns opened in the earlier segments of a conversation,
    summed over blocks of segments, then within a block."""
    whole = ["conv_id", "lone"]
    counts = pieces.groupBy(*whole, "segment").agg(F.count_if("opens").alias("n")).withColumn("block", F.floor(F.col("segment") / BLOCK))
    earlier = lambda by, order: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy(*whole, "block").agg(F.sum("n").alias("n")).withColumn("past", earlier(whole, "block")).drop("n")
    blocks = blocks.toDF(*[c if c == "past" else f"{c}_" for c in blocks.columns])
    inner = counts.withColumn("inner", earlier([*whole, "block"], "segment"))
    return inner.join(blocks, _same(*whole, "block")).select(*whole, "segment", (F.col("inner") + F.col("past")).alias("ahead"))


def parse(raw_transcripts: DataFrame, model: Model) -> DataFrame:
    """One row per recovered turn: conv_id, lone, position, role, text and the rendered form.

    Needs conv_id and transcript; segment, lone, before and after may be missing where each row
    is a whole transcript."""
    kind = raw_transcripts.schema["conv_id"].dataType.simpleString()
    default = {"lone": F.lit(None).cast("long"), "segment": F.lit(0).cast("long"), "before": F.lit(None).cast("string"), "after": F.lit(None).cast("string")}
    given = raw_transcripts.withColumns({c: v for c, v in default.items() if c not in raw_transcripts.columns})
    schema = f"conv_id {kind}, lone long, segment long, nth long, last boolean, opens boolean, role string, text string"
    decoded = given.select("conv_id", "lone", "segment", "before", "transcript", "after").mapInPandas(_parser(model), schema)
    pieces = Scratch(raw_transcripts.sparkSession, "chat").cut(decoded, "pieces")
    ahead = _opened_before(pieces)
    ahead = ahead.toDF(*[c if c == "ahead" else f"{c}_" for c in ahead.columns])
    # a piece that goes on has the number of the turn before it
    opened = F.col("nth") + F.when(F.min(F.struct("nth", "opens")).over(W.partitionBy("conv_id", "lone", "segment"))["opens"], 0).otherwise(-1)
    numbered = pieces.withColumn("opened", opened).join(ahead, _same("conv_id", "lone", "segment"))
    numbered = numbered.withColumn("position", (F.col("ahead") + F.col("opened")).cast("long")).select("conv_id", "lone", "segment", "position", "role", "text", "last", "opens")
    # only turns at the ends of segments can have several pieces
    edge = F.col("last") | ~F.col("opens")
    parts = F.array_sort(F.collect_list(F.struct("segment", "role", "text")))
    joined = numbered.where(edge).groupBy("conv_id", "lone", "position").agg(parts.alias("p"))
    joined = joined.select("conv_id", "lone", "position", F.element_at("p", 1)["role"].alias("role"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    turns = numbered.where(~edge).select("conv_id", "lone", "position", "role", "text").unionByName(joined)
    return turns.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n")))
