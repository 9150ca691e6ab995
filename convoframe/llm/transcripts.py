"""Roles of transcript lines by a hidden Markov model, and canonical turns.

A line is the first of a turn or a further one, of a user, an assistant or a system: six states. What is
seen of a line is its speaker marker, whether a blank line stands before it, and its length, question mark
and list sign. The model's tables are smoothed counts over marked-up lines, combined in Spark.

Viterbi runs over blocks of a transcript: each block is the max-plus product of its lines' matrices, blocks of
blocks are products again until one is left for a transcript, and the best states at the borders are then
carried down, so that a transcript of any length is split over tasks and the path is that of the
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoframe.session import materialise

ROLES = ("user", "assistant", "system")
# A state is 2 * role + (0 for a turn's first line, 1 for a further one).
STATES = 2 * len(ROLES)
BLOCK = 512

# Words that open a line and name its speaker, before a colon, an angle or within brackets.
SPEAKERS = {
    "user": ("user", "human", "customer", "question", "q", "me", "you"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model"),
    "system": ("system", "sys", "instructions", "note"),
}
_MARK = r"^\s*(?:[\[<(*]{1,2}\s*([A-Za-z]+)\s*[\])>*]{1,2}\s*:?|([A-Za-z]+)\s*[:>])\s*"


def with_observations(lines: DataFrame) -> DataFrame:
    """Adds ``mark`` (0 none, 1 user, 2 assistant, 3 system), ``said`` (the line without its marker) and ``seen``.

    Lines are (transcript, line, text), and ``blank`` tells whether blank lines stood before.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.lower(F.concat(F.regexp_extract(text, _MARK, 1), F.regexp_extract(text, _MARK, 2)))
    mark = F.lit(0)
    for at, role in enumerate(ROLES, 1):
        mark = F.when(name.isin(*SPEAKERS[role]), F.lit(at)).otherwise(mark)
    marked = lines.withColumn("mark", mark)
    said = F.when(F.col("mark") > 0, F.regexp_replace(text, _MARK, "")).otherwise(text)
    marked = marked.withColumn("said", said)
    length = F.length("said")
    size = F.when(length < 40, 0).when(length < 160, 1).otherwise(2)
    asks = F.col("said").rlike(r"\?\s*$").cast("int")
    listed = F.col("said").rlike(r"^\s*([-*#]|[0-9]+[.)])\s").cast("int")
    blank = F.coalesce("blank", F.lit(False)).cast("int")
    return marked.withColumn("seen", (((F.col("mark") * 2 + blank) * 3 + size) * 2 + asks) * 2 + listed)


def split_transcripts(texts: DataFrame, key: str = "transcript") -> DataFrame:
    """Lines of (``key``, text): transcript, line, text, blank. Blank lines only mark the next one."""
    parts = F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")).alias("line", "text")
    rows = texts.select(F.col(key).alias("transcript"), "text").select("transcript", parts)
    before = F.lag("text").over(Window.partitionBy("transcript").orderBy("line"))
    return rows.withColumn("blank", before.rlike(r"^\s*$")).where(~F.col("text").rlike(r"^\s*$"))


def fit(lines: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log tables (moves, emissions) from lines with known ``state`` and ``before`` (-1 at a transcript's start).

    Moves have a last row for the start. The parts of what is seen are taken as independent given the state.
    """
    observed = with_observations(lines)
    moves = np.full((STATES + 1, STATES), 0.5)
    for before, state, n in observed.groupBy("before", "state").count().collect():
        moves[before if before >= 0 else STATES, state] += n
    parts = [np.full((STATES, k), 0.5) for k in (4, 2, 3, 2, 2)]
    for state, seen, n in observed.groupBy("state", "seen").count().collect():
        for part, value in zip(parts, unpack(seen), strict=True):
            part[state, value] += n
    logs = [np.log(p / p.sum(axis=1, keepdims=True)) for p in parts]
    every = [unpack(s) for s in range(4 * 2 * 3 * 2 * 2)]
    emissions = np.array([[sum(p[s, v] for p, v in zip(logs, values, strict=True)) for values in every] for s in range(STATES)])
    moves = np.log(moves / moves.sum(axis=1, keepdims=True))
    return moves, emissions


def unpack(seen: int) -> tuple[int, int, int, int, int]:
    seen, listed = divmod(seen, 2)
    seen, asks = divmod(seen, 2)
    seen, size = divmod(seen, 3)
    mark, blank = divmod(seen, 2)
    return mark, blank, size, asks, listed


def _product(matrices: Iterator[np.ndarray]) -> np.ndarray:
    out = None
    for m in matrices:
        out = m if out is None else (out[:, :, None] + m[None, :, :]).max(axis=1)
    return out


def _path(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """States after each matrix on the best path from ``start``; ``end`` -1 is any. Ties go to the lower state."""
    score, came = None, []
    for m in matrices:
        if score is None:
            came.append(np.full(m.shape[1], start))
            score = m[start]
        else:
            reach = score[:, None] + m
            came.append(reach.argmax(axis=0))
            score = reach.max(axis=0)
    state = int(score.argmax()) if end < 0 else end
    out = []
    for back in reversed(came):
        out.append(state)
        state = int(back[state])
    return out[::-1]


class Model:
    """Matrices of lines: from the state before (the last row is the start) to the state of the line."""

    def __init__(self, moves: np.ndarray, emissions: np.ndarray) -> None:
        width = STATES + 1
        self.lines = np.full((emissions.shape[1], width, width), -np.inf)
        for seen in range(emissions.shape[1]):
            self.lines[seen, :, :STATES] = moves + emissions[:, seen]

    def of(self, seen) -> list[np.ndarray]:
        return [self.lines[s] for s in seen]


def _matrix(flat) -> np.ndarray:
    return np.asarray(flat, dtype=np.float64).reshape(STATES + 1, STATES + 1)


def viterbi(lines: DataFrame, model: Model, block: int = BLOCK, span: int = BLOCK) -> DataFrame:
    """(transcript, line, state) of the best path of each transcript over (transcript, line, seen).

    ``line`` numbers order a transcript's lines; they need not be consecutive. ``span`` line numbers are a
    block, ``block`` blocks are one of the next level; both bound what a task holds of a transcript, and the
    path is exact whatever they are.
    """
    kind = dict(lines.dtypes)["transcript"]
    blocks = lines.select("transcript", "line", "seen", F.floor(F.col("line") / span).cast("long").alias("at"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _product(iter(model.of(pdf.sort_values("line").seen)))
        return pd.DataFrame({"transcript": [pdf.transcript.iloc[0]], "at": [pdf["at"].iloc[0]], "m": [m.ravel()]})

    def fold_again(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _product(_matrix(x) for x in pdf.sort_values("at").m)
        return pd.DataFrame({"transcript": [pdf.transcript.iloc[0]], "at": [pdf.up.iloc[0]], "m": [m.ravel()]})

    schema = f"transcript {kind}, at long, m array<double>"
    levels = [materialise(blocks.groupBy("transcript", "at").applyInPandas(fold, schema), "matrices")]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) >= block:
        upper = levels[-1].withColumn("up", F.floor(F.col("at") / block).cast("long"))
        levels.append(materialise(upper.groupBy("transcript", "up").applyInPandas(fold_again, schema), "matrices"))

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        states = _path([_matrix(x) for x in pdf.m], int(pdf.enter.iloc[0]), int(pdf.leave.iloc[0]))
        enter = [int(pdf.enter.iloc[0]), *states[:-1]]
        return pd.DataFrame({"transcript": pdf.transcript, "at": pdf["at"], "enter": enter, "leave": states})

    held = None
    for level in reversed(levels):
        rows = level.withColumn("up", F.floor(F.col("at") / block).cast("long"))
        if held is None:
            rows = rows.withColumn("up", F.lit(0).cast("long"))
            rows = rows.select("*", F.lit(STATES).alias("enter"), F.lit(-1).alias("leave"))
        else:
            above = held.select(F.col("transcript").alias("t"), F.col("at").alias("u"), "enter", "leave")
            rows = rows.join(above, F.col("transcript").eqNullSafe(F.col("t")) & (F.col("up") == F.col("u"))).drop("t", "u")
        held = rows.groupBy("transcript", "up").applyInPandas(borders, f"transcript {kind}, at long, enter int, leave int")
        held = materialise(held, "borders")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        states = _path(model.of(pdf.seen), int(pdf.enter.iloc[0]), int(pdf.leave.iloc[0]))
        return pd.DataFrame({"transcript": pdf.transcript, "line": pdf.line, "state": states})

    ends = held.select(F.col("transcript").alias("t"), F.col("at").alias("u"), "enter", "leave")
    own = blocks.join(ends, F.col("transcript").eqNullSafe(F.col("t")) & (F.col("at") == F.col("u"))).drop("t", "u")
    return own.groupBy("transcript", "at").applyInPandas(decide, f"transcript {kind}, line long, state int")


def parse_transcripts(lines: DataFrame, model: Model, block: int = BLOCK, span: int = BLOCK) -> DataFrame:
    """Turns of transcripts: transcript, turn, role, text.

    ``lines`` are (transcript, line, text, blank); of rows that repeat a line's number the one with the least
    text stays, and rows without a number are left out. A turn begins where the path enters a first line; its
    text is its lines without markers, joined by line breaks. Null texts count as empty lines; null
    transcripts are one transcript. No lines give no turns. Transcripts may have any number of lines; a turn is one
    row. Other columns are not looked at, whatever their names.
    """
    kind = dict(lines.dtypes)["transcript"]
    numbered = lines.where("line is not null").groupBy("transcript", F.col("line").cast("long").alias("line"))
    rows = numbered.agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "blank")).alias("r"))
    rows = rows.select("transcript", "line", "r.text", "r.blank")
    observed = materialise(with_observations(rows), "lines")
    states = materialise(viterbi(observed, model, block, span), "states")
    # Turn numbers: starts before the block, by a running sum over its blocks, and those within it.
    placed = states.withColumn("at", F.floor(F.col("line") / span).cast("long"))
    starts = placed.groupBy("transcript", "at").agg(F.sum((F.col("state") % 2 == 0).cast("long")).alias("n"))
    before = Window.partitionBy("transcript").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        F.col("transcript").alias("t"), F.col("at").alias("u"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("transcript", "at").orderBy("line")
    run = F.sum((F.col("state") % 2 == 0).cast("long")).over(inside)
    placed = placed.join(starts, F.col("transcript").eqNullSafe(F.col("t")) & (F.col("at") == F.col("u")))
    placed = placed.select("transcript", "line", "state", (F.col("before") + run).alias("turn"))
    said = observed.select(F.col("transcript").alias("t"), F.col("line").alias("l"), "said")
    joined = placed.join(said, F.col("transcript").eqNullSafe(F.col("t")) & (F.col("line") == F.col("l")))
    turns = joined.groupBy("transcript", "turn").agg(
        F.min_by("state", "line").alias("state"),
        F.array_sort(F.collect_list(F.struct("line", "said"))).alias("rows"),
    )
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.floor(F.col("state") / 2) + 1).cast("int"))
    text = F.array_join(F.transform("rows", lambda x: x["said"]), "\n")
    return turns.select(F.col("transcript").cast(kind).alias("transcript"), "turn", role.alias("role"), text.alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """Adds ``canonical``: the role in angle signs, then the text, as one string for each turn."""
    return turns.withColumn("canonical", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text"))


def role_state(role: Column, first: Column) -> Column:
    """The state number of a line with a known role; null for other roles."""
    state = F.lit(None).cast("int")
    for at, name in enumerate(ROLES):
        state = F.when(role == name, F.lit(2 * at)).otherwise(state)
    return state + F.when(first, 0).otherwise(1)
