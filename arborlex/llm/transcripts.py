"""Transcript parsing: a hidden Markov model recovers the speakers of lines, then turns are rendered in one form.

Hidden states are (role, first line of a turn or a later one). A line shows four features: its speaker marker (the
spellings of MARKERS at its start, or none), whether it opens its row, or stands within it marked or not, its length in words by powers of
two, and whether it ends in a question mark. Starts, transitions, lengths and question marks are counted on conversations with
known roles; a share SMOOTH of each distribution is spread evenly, or for transitions as the role is followed. Sources with known roles have one turn a row and no markers,
so that they cannot teach markers and inner turns: these two features have stated probabilities (MARKED, INNER, UNMARKED, STRAY, WRONG).
By them, a marker at the start of a line opens a turn of its role, wherever it stands. Viterbi gives the best states, and
each run from one first line to the next is a turn.

A conversation may hold a third of all rows. Rows are sorted over the whole table, so that a conversation may go on from
one partition to the next, and numbered within it; only the first and last conversation of each partition are known to
the driver, to add what came before. BLOCK rows are a block. A block's lines are one
max-plus matrix, blocks combine to parents of BLOCK blocks by matrix products until one is left, and on the way down each
block learns the states at its two ends. No task sees more than a partition's rows or a parent's children, and the
path is the one that plain Viterbi finds, or one of equal probability. Counting follows the same order, and the driver adds the
transitions from partition to partition.

A null text is one empty line; a null turn number comes first; equal turn numbers go by role-blind hash of the text, then by place in the
input; rows that repeat are turns of their own; null conversation ids are one conversation. Roles outside ROLES (or null) do
not train, and break the chain. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import drop, materialise

# Roles, and the spellings that announce them.
ROLES = ("system", "user", "assistant")
MARKERS = {"system": ("system", "sys", "instructions"), "user": ("user", "human", "q", "me", "customer"), "assistant": ("assistant", "ai", "bot", "a", "agent", "model")}
BLOCK = 64
#: Share of each counted distribution that is spread evenly over its values.
SMOOTH = 1e-3
#: P(marker | first line of a turn), P(within a row, marked | first line of a turn), P(within a row, unmarked | first line
#: of a turn), P(marker | later line), and P(marker of another role | first line of a turn).
MARKED, INNER, UNMARKED, STRAY, WRONG = 0.5, 0.1, 1e-6, 1e-12, 1e-30
START = 2 * len(ROLES)  # before these, role * 2 + (0: first line, 1: later line)
STATES = START + 1
#: Values of each feature.
SIZES = (len(ROLES) + 1, 3, 8, 2)

_SPELLINGS = {s: k for k, role in enumerate(ROLES) for s in MARKERS[role]}
_MARKER = re.compile(r"\s*(?:\*\*|#+\s*|<\|?|\[)?\s*(" + "|".join(sorted(_SPELLINGS, key=len, reverse=True)) + r")\s*(?:\*\*)?\s*(?::|\|?>|\])(?:\*\*)?\s*", re.IGNORECASE)


def features(line: str, begins: bool) -> tuple[tuple[int, int, int, int], int]:
    """The values of the four features (the second: 0 within a row, 1 at its start, 2 within it and marked), and where the text after a marker starts."""
    found = _MARKER.match(line)
    marker, cut = (_SPELLINGS[found[1].lower()] + 1, found.end()) if found else (0, 0)
    words = len(line[cut:].split())
    return (marker, 1 if begins else 2 * (marker > 0), min(SIZES[2] - 1, words.bit_length()), int(line.rstrip().endswith("?"))), cut


@dataclass
class Model:
    """Log probabilities: move[i, j] from state to state, show[f][state, value]."""

    move: np.ndarray
    show: list[np.ndarray]

    def emissions(self, lines: list[tuple[int, int, int, int]]) -> np.ndarray:
        x = np.array(lines, np.int64).reshape(-1, len(SIZES))
        return sum(s[:, x[:, f]].T for f, s in enumerate(self.show))


def _stated(state: int) -> list[np.ndarray]:
    """Log probabilities of the marker and of the place in the row, which no counts can teach."""
    first, others = state % 2 == 0, len(ROLES) - 1
    marker = np.full(SIZES[0], WRONG if first else STRAY / len(ROLES))
    marker[0] = 1 - (MARKED if first else STRAY)
    if first and state != START:
        marker[1 + state // 2] = MARKED - others * WRONG
    return [np.log(marker), np.log([UNMARKED, 1 - INNER - UNMARKED, INNER] if first else [0.5, 1e-30, 0.5])]


def from_counts(counts: np.ndarray) -> Model:
    """counts: moves row by row, then each feature's values state by state."""

    def smoothed(x: np.ndarray, spread: np.ndarray) -> np.ndarray:
        total, even = x.sum(1, keepdims=True), spread / spread.sum(1, keepdims=True)
        share = np.where(total > 0, SMOOTH, 1.0)
        return (1 - share) * x / np.maximum(total, 1) + share * even

    allowed = np.ones((STATES, STATES))
    allowed[:, START] = 0
    for i in range(STATES):  # a later line keeps its role, and is not the first one
        for j in range(1, START, 2):
            allowed[i, j] = float(i // 2 == j // 2 and i != START)
    moves = counts[: STATES * STATES].reshape(STATES, STATES) * allowed
    spread = allowed.copy()
    for k in range(len(ROLES)):  # whoever speaks next follows the role, be its turn one line or several
        left = moves[2 * k : 2 * k + 2, 0:START:2].sum(0)
        spread[2 * k : 2 * k + 2, 0:START:2] = 0.01 + left / max(1.0, left.sum())
    with np.errstate(divide="ignore"):
        move = np.log(smoothed(moves, spread))
    show, at = [np.array(x) for x in zip(*(_stated(k) for k in range(STATES)), strict=True)], STATES * STATES
    for f, n in enumerate(SIZES):
        if f >= len(_stated(0)):
            show.append(np.log(smoothed(counts[at : at + STATES * n].reshape(STATES, n), np.ones((STATES, n)))))
        at += STATES * n
    return Model(np.maximum(move, -1e6), show)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def _path(steps: list[np.ndarray], start: int, end: int) -> list[int]:
    """The states after each step of the best way from start to end."""
    best, back = np.full(STATES, -np.inf), []
    best[start] = 0.0
    for m in steps:
        way = best[:, None] + m
        back.append(way.argmax(0))
        best = way.max(0)
    states = [end]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _lines(text: str | None) -> list[tuple[tuple[int, int, int, int], int, str]]:
    return [(*features(line, k == 0), line) for k, line in enumerate((text or "").split("\n"))]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _sorted(turns: DataFrame, conv: str, turn: str, text: str, role: str | None = None) -> DataFrame:
    """(conv, c, t, said, who), sorted by conversation and place over the whole table; the partitions are written so."""
    name = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    rows = turns.select(
        name.alias("conv"), F.col(turn).cast("long").alias("place"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("no"),
        F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(text).alias("said"), (F.col(role) if role else F.lit(None).cast("string")).alias("who"),
    )
    order = ["conv", "place", "tie", "no"]
    rows = materialise(rows)
    out = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).select("part", *order, "c", "t", "said", "who"))
    drop(rows)
    return out


def _edges(rows: DataFrame) -> dict[int, tuple[str, int]]:
    """For each part that goes on with a conversation of an earlier one: its name, and its rows before. Two rows for
    each part come to the driver."""
    counts = rows.groupBy("part", "conv").agg(F.count("*").alias("n"))
    ends = counts.groupBy("part").agg(F.min(F.struct("conv", "n")).alias("first"), F.max(F.struct("conv", "n")).alias("last"))
    found, open_ = {}, ("", 0)
    for row in sorted(ends.collect(), key=lambda r: r["part"]):
        first, last = row["first"], row["last"]
        before = open_[1] if open_[0] == first["conv"] else 0
        if before:
            found[row["part"]] = (first["conv"], before)
        open_ = (last["conv"], last["n"] + (before if first["conv"] == last["conv"] else 0))
    return found


def fit(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Counts over all given turns; what reaches the driver is the model's own table, and two states for each partition."""
    rows = _sorted(turns, conv, turn, text, role)
    size = STATES * (STATES + sum(SIZES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, counts = [], None
        for (part, name), own in _groups(batches, 2):
            if counts is None or part != edges[-1][0]:
                if counts is not None:
                    yield table(counts, edges)
                counts, edges = np.zeros(size, np.int64), []
            inner, last, first = bool(edges), START if edges else None, None
            for who, said in own:
                if who not in ROLES:
                    last, first = None, -1 if first is None else first
                    continue
                for k, (values, _, _) in enumerate(_lines(said)):
                    state, at = ROLES.index(who) * 2 + (k > 0), STATES * STATES
                    if last is not None:
                        counts[last * STATES + state] += 1
                    first = state if first is None else first
                    for n, v in zip(SIZES, values, strict=True):
                        counts[at + state * n + v] += 1
                        at += STATES * n
                    last = state
            edges.append((part, name, inner, first, -1 if last is None else last))
        if counts is not None:
            yield table(counts, edges)

    def table(counts: np.ndarray, edges: list[tuple]) -> pa.RecordBatch:
        """The counts, and the first and last conversation of a part, as at below 0."""
        some = np.flatnonzero(counts)
        ends = [edges[0], edges[-1]]
        columns = [pa.array([*some, -1, -2], pa.int64()), pa.array([*counts[some], 0, 0], pa.int64()), *(pa.array([None] * len(some) + [e[k] for e in ends], t) for k, t in ((0, pa.int64()), (1, pa.string()), (3, pa.int64()), (4, pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, names=["at", "n", "part", "name", "first", "last"])

    # a part may be read in pieces, whose order the place in it tells
    dealt = rows.repartition("part").sortWithinPartitions("part", "conv", "place", "tie", "no").select(F.col("part").cast("long").alias("part"), "conv", "who", "said")
    found = materialise(dealt.mapInArrow(run, "at long, n long, part long, name string, first long, last long"))
    counts = np.zeros(size)
    for row in found.where("at >= 0").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most one row for each entry of the model
        counts[row["at"]] = row["n"]
    open_ = None
    ends = found.where("at < 0").groupBy("part").agg(*(F.max(F.when(F.col("at") == k, F.struct("name", "first", "last"))).alias(x) for k, x in ((-1, "head"), (-2, "tail"))))
    for row in sorted(ends.collect(), key=lambda r: r["part"]):
        head, tail = row["head"], row["tail"]
        before = START if open_ is None or open_[0] != head["name"] else open_[1]
        if before >= 0 and head["first"] is not None and head["first"] >= 0:
            counts[before * STATES + head["first"]] += 1
        open_ = (tail["name"], tail["last"])
    return from_counts(counts)


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def parse(turns: DataFrame, model: Model, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, part, role, n_lines, rendered): the recovered turns; part counts those within an input row."""
    kinds = dict(turns.dtypes)
    rows = _sorted(turns, conv, turn, text)
    edges = _edges(rows)
    number = F.row_number().over(Window.partitionBy("part", "conv").orderBy("place", "tie", "no")) - 1
    if edges:  # no more entries than partitions
        before = rows.sparkSession.createDataFrame([(p, c, n) for p, (c, n) in edges.items()], "part int, conv string, before long")
        rows = rows.join(F.broadcast(before), ["part", "conv"], "left")
        number = number + F.coalesce("before", F.lit(0))
    said = rows.withColumn("place", number.cast("long")).select("conv", F.floor(F.col("place") / BLOCK).cast("long").alias("block"), "place", "c", "t", "said")
    said = materialise(said)
    blocks = (said.agg(F.max("block")).first()[0] or 0) + 1

    def block_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, block), own in _groups(batches, 2):
            m = None
            for (x,) in own:
                for e in model.emissions([v for v, _, _ in _lines(x)]):
                    step = model.move + e
                    m = step if m is None else _times(m, step)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), pa.array([m.tobytes()], pa.binary())], names=["conv", "block", "m"])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, parent), own in _groups(batches, 2):
            m = None
            for _, x in own:
                x = np.frombuffer(x).reshape(STATES, STATES)
                m = x if m is None else _times(m, x)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([parent]), pa.array([m.tobytes()], pa.binary())], names=["conv", "block", "m"])

    parent = F.floor(F.col("block") / BLOCK).cast("long")
    levels = [materialise(_dealt(said.select("conv", "block", "place", "said"), ["conv", "block"], ["place"]).select("conv", "block", "said").mapInArrow(block_matrix, "conv string, block long, m binary"))]
    while blocks > 1:
        up = _dealt(levels[-1].select("conv", parent.alias("parent"), "block", "m"), ["conv", "parent"], ["block"])
        levels.append(materialise(up.mapInArrow(product, "conv string, block long, m binary")))
        blocks = -(-blocks // BLOCK)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [int(np.frombuffer(x.as_py()).reshape(STATES, STATES)[START].argmax()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([START] * len(best), pa.int32()), pa.array(best, pa.int32())], names=["conv", "block", "entry", "exit"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, _), own in _groups(batches, 2):
            states = _path([np.frombuffer(m).reshape(STATES, STATES) for _, m, _, _ in own], own[0][2], own[0][3])
            made = [pa.array([name] * len(own)), pa.array([b for b, _, _, _ in own]), pa.array([own[0][2], *states[:-1]], pa.int32()), pa.array(states, pa.int32())]
            yield pa.RecordBatch.from_arrays(made, names=["conv", "block", "entry", "exit"])

    ends = materialise(levels[-1].mapInArrow(top, "conv string, block long, entry int, exit int"))
    for level in reversed(levels[:-1]):
        known = ends.withColumnRenamed("block", "parent")
        children = level.withColumn("parent", parent).join(known, ["conv", "parent"]).select("conv", "parent", "block", "m", "entry", "exit")
        ends = materialise(_dealt(children, ["conv", "parent"], ["block"]).mapInArrow(down, "conv string, block long, entry int, exit int"))

    def turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = batch.schema
            break
        else:
            return

        def again() -> Iterator[pa.RecordBatch]:
            yield batch
            yield from batches

        for _, own in _groups(again(), 2):
            parsed = [(c, t, _lines(x)) for _, _, c, t, x in own]
            steps = [model.move + e for _, _, lines in parsed for e in model.emissions([v for v, _, _ in lines])]
            states, out = iter(_path(steps, own[0][0], own[0][1])), []
            for c, t, lines in parsed:
                part = []
                for values, cut, line in lines:
                    state = next(states)
                    if not part or state % 2 == 0:
                        part.append([ROLES[state // 2], []])
                    part[-1][1].append(line[cut:] if values[0] and state % 2 == 0 else line)
                out += [(c, t, k, who, len(x), render(who, "\n".join(x))) for k, (who, x) in enumerate(part)]
            types = [schema.field(4).type, schema.field(5).type, pa.int32(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(types)], names=["c", "t", "part", "role", "n_lines", "rendered"])

    joined = said.join(ends, ["conv", "block"]).select("conv", "block", "place", "entry", "exit", "c", "t", "said")
    dealt = _dealt(joined, ["conv", "block"], ["place"]).select("conv", "block", "entry", "exit", "c", "t", "said")
    out = dealt.mapInArrow(turns_of, f"c {kinds[conv]}, t {kinds[turn]}, part int, role string, n_lines long, rendered string")
    return out.select(F.col("c").alias(conv), F.col("t").alias(turn), "part", "role", "n_lines", "rendered")
