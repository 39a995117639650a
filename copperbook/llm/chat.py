"""Chat formatting: roles of a transcript recovered by a hidden Markov model.

A transcript is text; its lines are observations and the states are the first
line and the further lines of a turn of each role. A line shows the role its
speaker marker names (or that it has none), how long it is, and how it ends.
Start, transition and emission probabilities are counted with Spark from
transcripts whose lines are labelled, with one count added everywhere. Viterbi
finds the likeliest states of a transcript in time proportional to its lines;
a turn is a first line with the lines after it. Turns are then written in one
canonical form.

Rows: null and empty texts have no turns; lines of blanks belong to the turn
they stand in; ties go to the role listed first; text before any marker gets the
role the model finds likeliest; ``parse`` takes a transcript whole, and its length
bounds the work of one row; repeated rows are each parsed; an empty table gives
an empty result; a model without training rows goes by the markers. Extra
columns are ignored.

Long conversations are cut into stretches of rows. Their states are those of the
uncut transcript: a stretch gives the best score from each state before it to
each of its last line, a tree over these matrices gives every stretch the state
it starts from and the one it ends in, and Viterbi fills in what lies between.
Rows of a conversation are numbered by turn, role and text, nulls first and
repeated rows each, so null or equal turns are cut like others; rows of null
conv_id are one conversation. A turn that runs over a cut gives a piece in both
stretches, and ``continues`` marks the second.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperbook.llm.common import only, stored
from copperbook.operators.ordered import row_numbers

ROLES = ("system", "user", "assistant", "tool")
#: The names speakers go by.
SPEAKERS = {
    "system": ("system", "context", "sys"),
    "user": ("user", "human", "q", "question", "instruction", "customer", "prompt", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "response", "model", "agent"),
    "tool": ("tool", "function", "observation", "output"),
}
_ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in SPEAKERS[role]}
_NAME = "|".join(sorted(_ROLE_OF, key=lambda n: (-len(n), n)))
#: "Name:", "**Name**:", "### Name:", "[Name]", "<|name|>", "Name>"
_MARKER = re.compile(
    rf"[ \t]*(?:#+[ \t]*(?P<a>{_NAME})[ \t]*:?(?=\s|$)|\*\*(?P<b>{_NAME})\*\*[ \t]*:?|\[(?P<c>{_NAME})\]:?"
    rf"|<\|(?P<d>{_NAME})\|>|(?P<e>{_NAME})[ \t]*(?::|>)(?!\S*//))[ \t]*",
    re.IGNORECASE,
)
_NO_MARKER = len(ROLES)
_LENGTHS = (0, 4, 12, 30, 80, 200)  # words
_ENDS = 4  # blank, question, sentence, other
N_STATES = 2 * len(ROLES)  # first line, further line of each role


def read_line(line: str) -> tuple[int, int, int, str]:
    """Marker, length class, end class, and the line without its marker."""
    found = _MARKER.match(line)
    marker, rest = _NO_MARKER, line
    if found:
        marker, rest = _ROLE_OF[found[found.lastgroup].lower()], line[found.end() :]
    words = len(rest.split())
    length = sum(words > n for n in _LENGTHS)
    last = rest.rstrip()[-1:]
    end = 0 if not last else 1 if last == "?" else 2 if last in ".!\u2026" else 3
    return marker, length, end, rest


@dataclass(frozen=True)
class Model:
    """Log probabilities."""

    start: np.ndarray
    move: np.ndarray
    marker: np.ndarray
    length: np.ndarray
    end: np.ndarray

    @staticmethod
    def counted(counts: dict[tuple[str, int, int], int]) -> "Model":
        """From counts keyed by (table, row, column)."""

        def table(name: str, rows: int, columns: int, prior: np.ndarray | float = 0.0) -> np.ndarray:
            out = np.ones((rows, columns)) + prior
            for (kind, row, column), n in counts.items():
                if kind == name:
                    out[row, column] += n
            return np.log(out / out.sum(axis=1, keepdims=True))

        move = table("move", N_STATES, N_STATES)
        for state in range(N_STATES):  # a further line is of the same turn
            for other in range(len(ROLES)):
                if state % len(ROLES) != other:
                    move[state, len(ROLES) + other] = -math.inf
        start = table("start", 1, N_STATES)[0]
        start[len(ROLES) :] = -math.inf
        # what a marker is for: a first line has its own, a further line has none
        speaks = np.zeros((N_STATES, len(ROLES) + 1))
        speaks[np.arange(len(ROLES)), np.arange(len(ROLES))] = 8
        speaks[len(ROLES) :, _NO_MARKER] = 8
        return Model(
            start,
            move,
            table("marker", N_STATES, len(ROLES) + 1, speaks),
            table("length", N_STATES, len(_LENGTHS) + 1),
            table("end", N_STATES, _ENDS),
        )

    def _seen(self, lines: list[tuple[int, int, int, str]]) -> np.ndarray:
        marker, length, end = (np.array([x[k] for x in lines]) for k in range(3))
        return self.marker[:, marker] + self.length[:, length] + self.end[:, end]

    def states(self, lines: list[tuple[int, int, int, str]], entry: int | None = None, end: int | None = None) -> list[int]:
        """Viterbi; ties go to the state listed first. ``entry`` is the state before
        the first line, ``end`` that of the last, where they are known."""
        if not lines:
            return []
        seen = self._seen(lines)
        best, back = (self.start if entry is None else self.move[entry]) + seen[:, 0], []
        for at in range(1, len(lines)):
            paths = best[:, None] + self.move
            came = paths.argmax(axis=0)
            back.append(came)
            best = paths[came, np.arange(N_STATES)] + seen[:, at]
        state = int(best.argmax()) if end is None else end
        out = [state]
        for came in reversed(back):
            state = int(came[state])
            out.append(state)
        return out[::-1]

    def scores(self, lines: list[tuple[int, int, int, str]], first: bool) -> np.ndarray:
        """The best score from each state before the lines to each of the last, less
        the greatest. Before the ``first`` lines of a transcript all are alike."""
        seen = self._seen(lines)
        best = (np.tile(self.start, (N_STATES, 1)) if first else self.move) + seen[:, 0]
        for at in range(1, len(lines)):
            best = through(best, self.move) + seen[:, at]
        return best - best.max()

    def turns(self, text: str | None, entry: int | None = None, end: int | None = None) -> tuple[bool, list[tuple[str, str]]]:
        """(role, text) of each turn, and whether the first goes on from the text
        before. A text whose ``end`` is known is a stretch, which has a line even
        when empty."""
        if not text and end is None:
            return False, []
        lines = [read_line(line) for line in (text or "").split("\n")]
        states = self.states(lines, entry, end)
        out: list[tuple[str, list[str]]] = []
        for state, line in zip(states, lines):
            if state < len(ROLES) or not out:
                out.append((ROLES[state % len(ROLES)], []))
            out[-1][1].append(line[3])
        return states[0] >= len(ROLES), [(role, "\n".join(body).strip()) for role, body in out]


def through(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best scores by way of the states between."""
    return (a[..., :, None] + b).max(axis=-2)


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form: a header line with the role, the text, an end mark."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def train(labelled: DataFrame, lines_col: str = "lines") -> Model:
    """From transcripts whose ``lines`` are structs of line, role and first (does
    it begin a turn?). Lines of other roles than the known break the chain."""
    counts = only(labelled, lines_col).mapInArrow(_counted, "kind string, row int, col int, n long")
    rows = counts.groupBy("kind", "row", "col").agg(F.sum("n").alias("n")).collect()  # at most a few hundred
    return Model.counted({(r["kind"], r["row"], r["col"]): r["n"] for r in rows})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lines in batch.column(0).to_pylist():
            was = None
            for place, one in enumerate(lines or []):
                if one["role"] not in ROLES:
                    was = None
                    continue
                state = ROLES.index(one["role"]) + (0 if one["first"] else len(ROLES))
                for kind, value in zip(("marker", "length", "end"), read_line(one["line"] or "")):
                    counts[kind, state, value] += 1
                if was is not None:
                    counts["move", was, state] += 1
                elif place == 0:
                    counts["start", 0, state] += 1
                was = state
        kind, row, col = (pa.array([k[i] for k in counts], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32())))
        yield pa.record_batch({"kind": kind, "row": row, "col": col, "n": pa.array(list(counts.values()), pa.int64())})


def parse(
    transcripts: DataFrame,
    model: Model,
    id_col: str = "conv_id",
    text_col: str = "text",
    entry_col: str | None = None,
    end_col: str | None = None,
) -> DataFrame:
    """Per row: the id, roles in order, number of turns, the canonical form, and
    whether the first turn goes on from the stretch before. ``entry_col`` and
    ``end_col`` name states known from ``ends_of_stretches``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goes_on, found = [], []
            for text, entry, end in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                first, turns = model.turns(text, entry, end)
                goes_on.append(first)
                found.append(turns)
            yield pa.record_batch(
                {
                    "conv_id": batch.column(0),
                    "n_turns": pa.array([len(f) for f in found], pa.int64()),
                    "roles": pa.array([",".join(r for r, _ in f) for f in found], pa.string()),
                    "rendered": pa.array([render(f) for f in found], pa.string()),
                    "continues": pa.array(goes_on, pa.bool_()),
                }
            )

    known = [F.lit(None).cast("int") if c is None else F.col(c) for c in (entry_col, end_col)]
    plain = transcripts.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{text_col}`").alias("text"), *known)
    kind = plain.schema["conv_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"conv_id {kind}, n_turns long, roles string, rendered string, continues boolean")


#: Rows of a conversation that make up one stretch, and nodes below one of the tree.
STRETCH, FAN = 512, 512


def ends_of_stretches(stretches: DataFrame, model: Model, fan: int = FAN) -> DataFrame:
    """From (conv_id, stretch, text): conv_id, stretch, and the states on the
    likeliest path through the whole conversation before the stretch (null before
    the first) and at its end.

    Matrices of scores are joined up a tree of ``fan`` nodes below each, and what
    precedes and ends a node is handed down it; no group has more than ``fan`` rows
    of 64 numbers, however long a conversation is.
    """
    kind = stretches.schema["conv_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [
                model.scores([read_line(line) for line in (text or "").split("\n")], place == 0).ravel()
                for place, text in zip(places, texts)
            ]
            rows = pa.array(found, pa.list_(pa.float64()))
            yield pa.record_batch({"conv_id": batch.column(0), "node": batch.column(1), "scores": rows})

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        whole = None
        for one in _matrices(group):
            whole = one if whole is None else through(whole, one)
        row = group.iloc[:1].assign(node=group["node"].iloc[0] // fan)
        return row.assign(scores=[(whole - whole.max()).ravel()])

    def handed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node").reset_index(drop=True)
        given = group["given"].iloc[0]
        before, steps = [np.asarray(given["before"], float)], _matrices(group)
        for one in steps[:-1]:
            after = through(before[-1], one)
            before.append(after - after.max())
        ends = [given["end"]]
        if ends[0] is None or np.isnan(ends[0]):
            ends = [int(through(before[-1], steps[-1]).argmax())]
        for scores, one in zip(before[:0:-1], steps[:0:-1]):
            ends.append(int((scores + one[:, int(ends[-1])]).argmax()))
        ends = [int(e) for e in ends[::-1]]
        entries = [given["entry"], *ends[:-1]]
        return pd.DataFrame(
            {
                "conv_id": group["conv_id"],
                "node": group["node"],
                "entry": pd.array([None if e is None or np.isnan(e) else int(e) for e in entries], "Int32"),
                "end": pd.array(ends, "Int32"),
                "before": before,
            }
        )

    shape = f"conv_id {kind}, node long, scores array<double>"
    levels = [stored(stretches.select("conv_id", "stretch", "text").mapInArrow(scored, shape), "chat-scores")]
    while levels[-1].where(F.col("node") > 0).limit(1).count():
        up = levels[-1].groupBy("conv_id", F.floor(F.col("node") / fan).alias("parent"))
        levels.append(stored(up.applyInPandas(lambda _, group: joined(group), shape), "chat-scores"))
    top = levels.pop().select(
        "conv_id", "node", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("int").alias("end"),
        F.array_repeat(F.lit(0.0), N_STATES).alias("before"),
    )
    known = top
    for level in reversed(levels):
        given = known.select(
            F.col("conv_id").alias("__conv"), F.col("node").alias("__node"), F.struct("entry", "end", "before").alias("given")
        )
        parent = F.floor(F.col("node") / fan)
        below = level.join(given, F.col("conv_id").eqNullSafe(F.col("__conv")) & (parent == F.col("__node")))
        known = below.groupBy("conv_id", "__node").applyInPandas(
            lambda _, group: handed(group), f"conv_id {kind}, node long, entry int, end int, before array<double>"
        )
    return known.select("conv_id", F.col("node").alias("stretch"), "entry", "end")


def _matrices(group: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(x, float).reshape(N_STATES, N_STATES) for x in group["scores"]]


#: How the registered query writes a role: name by style, then the form.
_STYLES = (
    (("System", "User", "Assistant", "Tool"), "%s: "),
    (("Context", "Human", "AI", "Function"), "%s: "),
    (("System", "Instruction", "Response", "Output"), "### %s:\n"),
    (("Context", "Q", "A", "Observation"), "**%s**: "),
    (("system", "user", "assistant", "tool"), "<|%s|>\n"),
    (("sys", "user", "bot", "tool"), "[%s] "),
)


def _heading(conv: Column, turn: Column, role: Column) -> Column:
    """The marker of a turn in its conversation's style; every eighth turn or so
    goes without one, as in transcripts found in the wild."""
    style = F.pmod(F.xxhash64(conv, F.lit(1)), F.lit(len(_STYLES))).cast("int")
    forms = F.array(*[F.array(*[F.lit(form % n) for n in names]) for names, form in _STYLES])
    place = F.array_position(F.array(*[F.lit(r) for r in ROLES]), role).cast("int") - 1
    bare = F.pmod(F.xxhash64(conv, turn, F.lit(2)), F.lit(8)) == 0
    return F.when(bare | (place < 0) | place.isNull(), "").otherwise(F.get(F.get(forms, style), place))


def transcripts_of(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """conversations(conv_id, turn, role, text) as transcripts(conv_id, stretch,
    text, true_roles, lines). A conversation of more than ``stretch`` rows gives
    several."""
    plain = only(conversations, "conv_id", "turn", "role", "text").withColumn("tie", F.xxhash64("text"))
    plain = row_numbers(plain, ["turn", "role", "tie"], "row", within=("conv_id",))
    body = F.concat(_heading(F.col("conv_id"), F.col("turn"), F.col("role")), F.coalesce("text", F.lit("")))
    turns = F.sort_array(
        F.collect_list(F.struct("row", F.coalesce("role", F.lit("")).alias("role"), body.alias("body")))
    )
    lines = F.flatten(
        F.transform(
            "turns",
            lambda t: F.transform(
                F.split(t["body"], "\n"),
                lambda line, k: F.struct(line.alias("line"), t["role"].alias("role"), (k == 0).alias("first")),
            ),
        )
    )
    return (
        plain.groupBy("conv_id", F.floor((F.col("row") - 1) / stretch).alias("stretch"))
        .agg(turns.alias("turns"))
        .select(
            "conv_id",
            "stretch",
            F.array_join(F.transform("turns", lambda t: t["body"]), "\n").alias("text"),
            F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("true_roles"),
            lines.alias("lines"),
        )
    )


def format_conversations(
    conversations: DataFrame, model: Model | None = None, stretch: int = STRETCH, fan: int = FAN
) -> DataFrame:
    """The registered query: transcripts of all conversations, a model counted on
    four fifths of them unless given, and every transcript parsed by it, cut or not.
    Counting leaves out the moves over cuts."""
    transcripts = stored(transcripts_of(conversations, stretch), "chat-transcripts")
    learnable = F.pmod(F.xxhash64("conv_id", F.lit(3)), F.lit(5)) != 0
    # a later stretch does not begin a transcript
    cut_off = F.array(F.struct(F.lit("").alias("line"), F.lit("").alias("role"), F.lit(False).alias("first")))
    lines = F.when(F.col("stretch") > 0, F.concat(cut_off, "lines")).otherwise(F.col("lines"))
    model = model or train(transcripts.where(learnable).select(lines.alias("lines")))
    cut = transcripts.where("stretch > 0").select(F.col("conv_id").alias("__cut")).distinct()
    same = F.col("conv_id").eqNullSafe(F.col("__cut"))
    ends = ends_of_stretches(transcripts.join(cut, same, "left_semi"), model, fan).toDF("__conv", "__stretch", "entry", "end")
    here = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("stretch") == F.col("__stretch"))
    keyed = transcripts.join(ends, here, "left").select(
        F.struct("conv_id", "stretch", "true_roles", (~learnable).alias("held_out")).alias("key"), "text", "entry", "end"
    )
    return parse(keyed, model, "key", "text", "entry", "end").select(
        "conv_id.conv_id",
        "conv_id.stretch",
        "conv_id.held_out",
        "n_turns",
        "roles",
        ((F.col("roles") == F.col("conv_id.true_roles")) & ~F.col("continues")).alias("roles_right"),
        "rendered",
        "continues",
    )
