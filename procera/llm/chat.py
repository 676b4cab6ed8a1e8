"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, ending with the assistant. Dynamic programming over that
automaton picks, for every given turn, its role and whether it joins the
previous turn or needs empty turns before it, at least total cost: MERGE for
joining, RELABEL for another role (UNKNOWN for a role that is none of the three),
INSERT for an empty turn. Of equal costs the lower state (system, user,
assistant) wins, from the end backwards. No turn is dropped.

A step of the automaton is a small min-plus matrix that depends on the role only, so the
program splits anywhere: turns are range-sorted, cut into pieces of at most
PIECE turns of one conversation, each piece is summed up in one matrix, the
pieces of a conversation are chained over their matrices, and every piece is then
solved with its two ends fixed. One endless conversation is many pieces.

Defined results: turns stand in order of turn (NULL first), then role and text;
NULL text is empty; role names are trimmed and compared without case; NULL is an unknown role.
NULL conv_id is one conversation. Repeated rows are turns of their own. A table without
rows has none. Extra columns are ignored, whatever their names. Rendered turns in order of place are the
conversation's text, of any length; rows equal in all are next to each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.llm.common import written

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
PIECE = 4096
#: Characters of a text that are looked at where turns are dealt to tasks.
TIE = 64
NEVER = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"

#: Empty turns needed between a state and the next turn's role; absent: impossible.
BETWEEN: dict[tuple[int, int], tuple[int, ...]] = {
    (START, SYSTEM): (),
    (START, USER): (),
    (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (),
    (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (),
    (ASSISTANT, USER): (),
}
#: Empty turns needed after the last turn.
AFTER = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def step(role: int) -> np.ndarray:
    """Cost from state to state of a turn whose given role is 0 to 2, or 3 if unknown."""
    cost = np.full((4, 4), NEVER)
    for to in (SYSTEM, USER, ASSISTANT):
        label = UNKNOWN if role == 3 else 0 if role == to - 1 else RELABEL
        for at in range(4):
            if at == to:
                cost[at, to] = label + MERGE
            elif (at, to) in BETWEEN:
                cost[at, to] = label + INSERT * len(BETWEEN[at, to])
    return cost


STEPS = np.stack([step(r) for r in range(4)])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NEVER)


def product(roles: list[int]) -> np.ndarray:
    """Min-plus product of the steps, by halves."""
    parts = STEPS[roles]
    while len(parts) > 1:
        odd = parts[-1:] if len(parts) % 2 else parts[:0]
        a, b = parts[0 : len(parts) - len(odd) : 2], parts[1 : len(parts) - len(odd) + 1 : 2]
        parts = np.concatenate((np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(2), NEVER), odd))
    return parts[0]


def path(steps: list[np.ndarray], begin: int, ends: np.ndarray) -> list[int]:
    """States after each step of a cheapest way from `begin`, `ends` being the cost of stopping in a state."""
    best = [np.where(np.arange(4) == begin, 0, NEVER)]
    for s in steps:
        best.append(np.minimum((best[-1][:, None] + s).min(0), NEVER))
    state = int(np.argmin(best[-1] + ends))
    out = [state]
    for before, s in zip(best[-2:0:-1], steps[:0:-1], strict=True):
        state = int(np.argmin(before + s[:, state]))
        out.append(state)
    return out[::-1]


ENDS = np.array([NEVER, *(INSERT * len(AFTER[s]) for s in (SYSTEM, USER, ASSISTANT))])


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of the task, and of each row in it."""
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part)), pa.array(np.arange(at, at + n))], [*b.schema.names, "part", "pos"])
        at += n


def staged(turns: DataFrame) -> DataFrame:
    """Turns in global order, in written pieces. The place is fixed by the written table, not by a later sort."""
    kinds = dict(turns.dtypes)
    role = F.lower(F.trim("role"))
    code = F.when(role == "system", 0).when(role == "user", 1).when(role == "assistant", 2).otherwise(3)
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), code.cast("bigint").alias("code"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    # Ranges end between different beginnings of texts, so that the order by whole texts is one order.
    ordered = rows.repartitionByRange(*order, F.substring("text", 1, TIE)).sortWithinPartitions(*order, "text")
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, code bigint, part bigint, pos bigint"
    return written(ordered.mapInArrow(_numbered, schema).withColumn("slab", F.floor(F.col("pos") / PIECE)), "chat-turns")


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [product([x["code"] for x in sorted(group.as_py(), key=lambda x: x["pos"])]).ravel().tolist() for group in b.column(3)]
        size = pa.array([len(group) for group in b.column(3)], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(got, pa.list_(pa.int64())), size], ["conv_id", "part", "slab", "matrix", "n"])


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states between the pieces of a conversation, and the turns before each piece."""
    for b in batches:
        rows: list[tuple] = []
        for conv, group in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            pieces = sorted(group.as_py(), key=lambda x: (x["part"], x["slab"]))
            states = path([np.array(x["matrix"]).reshape(4, 4) for x in pieces], START, ENDS)
            last = [False] * (len(pieces) - 1) + [True]
            before = accumulate([0, *(x["n"] for x in pieces)])
            rows += [(conv, x["part"], x["slab"], *ends) for x, *ends in zip(pieces, [START, *states], states, last, before, strict=False)]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (b.schema.field(0).type, *[pa.int64()] * 4, pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["conv_id", "part", "slab", "enter", "leave", "last", "before"])


def solved(roles: list[int], enter: int, leave: int) -> list[int]:
    """States after each turn of a piece whose ends are fixed."""
    return path([STEPS[r] for r in roles], enter, np.where(np.arange(4) == leave, 0, NEVER))


def rendered(text: str, before: int, state: int, last: bool) -> tuple[str, tuple[int, ...], tuple[int, ...]]:
    """The turn's share of the conversation's text, and the states of empty turns inserted before and after it.

    A turn that does not join the previous one closes that one's block; the last turn closes its own.
    """
    empty = lambda states: "".join(OPEN.format(ROLES[s - 1]) + CLOSE for s in states)
    joins = before == state
    ahead = () if joins else BETWEEN[before, state]
    behind = AFTER[state] if last else ()
    shut = "\n" + CLOSE
    out = "\n\n" if joins else (shut if before != START else "") + empty(ahead) + OPEN.format(ROLES[state - 1])
    return out + text.replace("<|", "<\\|") + (shut + empty(behind) if last else ""), ahead, behind


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for conv, enter, leave, ends, ahead_of, group in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5), strict=True):
            turns = sorted(group.as_py(), key=lambda x: x["pos"])
            states = solved([x["code"] for x in turns], enter, leave)
            for i, (x, before, state) in enumerate(zip(turns, [enter, *states], states, strict=False)):
                text, ahead, behind = rendered(x["text"], before, state, ends and i == len(turns) - 1)
                label = UNKNOWN if x["code"] == 3 else 0 if x["code"] == state - 1 else RELABEL
                cost = label + MERGE * (before == state) + INSERT * len(ahead + behind)
                names = [",".join(ROLES[s - 1] for s in states_) or None for states_ in (ahead, behind)]
                rows.append((conv, ahead_of + i, x["turn"], x["role"], ROLES[state - 1], before == state, *names, cost, text))
        columns = list(zip(*rows, strict=True)) or [()] * 10
        turn = b.column(5).type.value_type.field("turn").type
        kinds = (b.schema.field(0).type, pa.int64(), turn, pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["conv_id", "place", "turn", "role", "new_role", "merged", "inserted_before", "inserted_after", "cost", "rendered"])


def repaired(turns: DataFrame) -> DataFrame:
    """One row per turn: place (from 0, in its conversation), new_role, merged, roles inserted before and after, cost, rendered text."""
    conv, turn = (dict(turns.dtypes)[c] for c in ("conv_id", "turn"))
    rows = staged(turns)
    short = rows.groupBy("conv_id", "part", "slab").agg(F.collect_list(F.struct("pos", "code")).alias("turns"))
    matrices = short.mapInArrow(_matrices, f"conv_id {conv}, part bigint, slab bigint, matrix array<bigint>, n bigint")
    chains = matrices.groupBy("conv_id").agg(F.collect_list(F.struct("part", "slab", "matrix", "n")).alias("pieces"))
    ends = chains.mapInArrow(_chained, f"conv_id {conv}, part bigint, slab bigint, enter bigint, leave bigint, last boolean, before bigint")
    ends = written(ends.withColumnsRenamed({"conv_id": "_conv", "part": "_part", "slab": "_slab"}), "chat-ends")
    pieces = rows.groupBy("conv_id", "part", "slab").agg(F.collect_list(F.struct("part", "pos", "turn", "role", "code", "text")).alias("turns"))
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("slab") == F.col("_slab"))
    fixed = pieces.join(ends, on).select("conv_id", "enter", "leave", "last", "before", "turns")
    schema = f"conv_id {conv}, place bigint, turn {turn}, role string, new_role string, merged boolean, inserted_before string, inserted_after string, cost bigint, rendered string"
    return fixed.mapInArrow(_repaired, schema)


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation with its whole text: for conversations that fit a row."""
    lines = F.array_sort(F.collect_list(F.struct("place", "rendered")))
    grouped = repaired(turns).groupBy("conv_id").agg(lines.alias("lines"), F.sum("cost").alias("cost"), F.count("*").alias("n_turns"))
    return grouped.select("conv_id", "n_turns", "cost", F.array_join(F.transform("lines", lambda x: x["rendered"]), "").alias("text"))
