"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with
an assistant. Each turn is kept, relabelled or merged into the turn before it, and empty turns
may be inserted, at the least total cost.

All turns are sorted into ranges by conversation and turn, so that one exchange serves and a
hot conversation spreads over many tasks. A conversation that lies within a range, as nearly
all do, is repaired there. The first and last ones of a range, and long ones, fall into
segments of a bounded number of rows. The automaton has four states, so a segment is a 4 x 4
matrix of costs in the (min, +) algebra: the matrices are chained for each conversation, and
every segment then finds its own cheapest path between the states that the chain chose.

Ties: at each turn the path prefers, from the end backwards, the smaller state before it, and
then the smaller of (insertions, merge after emit).

Defined cases: roles compare trimmed and in lower case, and any other or null role must be
relabelled or merged; a null text is empty; a null turn number comes first; turns with one
number go by role, the first characters of the text and its hash, so that repeated rows are
turns each; rows without a conv_id form one conversation; a conversation without rows does not
exist, and an empty table gives no rows; a text that holds a marker such as <|end|> is rendered
as it is, since tokenizers encode markers apart from text; texts are held whole, and a repaired
turn has the whole text of all turns merged into it; extra columns are not read, whatever their
names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, parts, table

ROLES = ("", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1, 3, 2
FAR = 1 << 40
#: Rows of a segment of a long conversation, and characters after which one ends.
SEGMENT, SEGMENT_CHARS = 2048, 1 << 22
#: Turns in a range, at most about.
RANGE = 100_000


def _inserted() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest chain of inserted turns from one state to another."""
    out = {(q, q): () for q in range(4)}
    grown = True
    while grown:
        grown = False
        for (a, b), chain in list(out.items()):
            for c in NEXT[b]:
                if (a, c) not in out or len(chain) + 1 < len(out[a, c]):
                    out[a, c], grown = (*chain, c), True
    return out


INSERTED = _inserted()


def _moves() -> dict[int, list[tuple[int, int, int, tuple[int, ...], str]]]:
    """For each role the cheapest move between two states: (from, to, cost, insertions, action)."""
    out = {}
    for role in range(4):
        best: dict[tuple[int, int], tuple] = {}
        for (a, p), chain in INSERTED.items():
            for x in NEXT[p]:
                move = (INSERT * len(chain) + (0 if x == role else RELABEL), chain, 0, "keep" if x == role else "relabel")
                best[a, x] = min(best.get((a, x), (FAR,)), move)
            if p != START:
                move = (INSERT * len(chain) + MERGE + (0 if p == role else RELABEL), chain, 1, "merge" if p == role else "relabel+merge")
                best[a, p] = min(best.get((a, p), (FAR,)), move)
        out[role] = sorted((a, b, m[0], m[1], m[3]) for (a, b), m in best.items())
    return out


MOVES = _moves()


def finish(state: int) -> tuple[int, tuple[int, ...]]:
    """(cost, insertions) that end a conversation in a legal state."""
    chain = INSERTED[state, ASSISTANT]
    return INSERT * len(chain), chain


def forward(roles: list[int], first: int) -> tuple[list[int], list[int]]:
    """(least cost, turns made on that path) to each state after `roles`."""
    cost, made = [0 if q == first else FAR for q in range(4)], [0] * 4
    for r in roles:
        row, out = [FAR] * 4, [0] * 4
        for a, b, c, ins, act in MOVES[r]:
            if cost[a] + c < row[b]:
                row[b], out[b] = cost[a] + c, made[a] + len(ins) + ("merge" not in act)
        cost, made = row, out
    return cost, made


def chain(matrices: list[np.ndarray]) -> list[int]:
    """States before, between and after the segments of a conversation, START first."""
    best = [np.array([0, FAR, FAR, FAR])]
    for m in matrices:
        best.append(np.minimum((best[-1][:, None] + m).min(0), FAR))
    state = min(range(1, 4), key=lambda q: (best[-1][q] + finish(q)[0], q))
    out = [state]
    for k in range(len(matrices) - 1, -1, -1):
        cost = best[k + 1][out[-1]]
        out.append(next(q for q in range(4) if best[k][q] + matrices[k][q, out[-1]] == cost))
    return out[::-1]


def path(roles: list[int] | tuple[int, ...], first: int, last: int) -> list[tuple[int, tuple[int, ...], str]]:
    """(state after, insertions before, action) of every turn, from `first` to `last`."""
    best = [[0 if q == first else FAR for q in range(4)]]
    for r in roles:
        row = [FAR] * 4
        for a, b, cost, _, _ in MOVES[r]:
            if best[-1][a] + cost < row[b]:
                row[b] = best[-1][a] + cost
        best.append(row)
    out, state = [], last
    for k in range(len(roles) - 1, -1, -1):
        a, ins, act = next((a, ins, act) for a, b, cost, ins, act in MOVES[roles[k]] if b == state and best[k][a] + cost == best[k + 1][state])
        out.append((state, ins, act))
        state = a
    return out[::-1]


@lru_cache(maxsize=1 << 14)
def _whole_path(roles: tuple[int, ...]) -> tuple[tuple, int]:
    """The path of a whole conversation and its last state."""
    cost, _ = forward(list(roles), START)
    last = min(range(1, 4), key=lambda q: (cost[q] + finish(q)[0], q))
    return tuple(path(roles, START, last)), last


def turns_of(steps, texts: list[str], last: int, ends: bool) -> list[tuple[int, str, int, list[str], list[str]]]:
    """(number, role, turns, actions, texts) of the repaired turns; number 0 goes on with the turn before."""
    out: list[tuple[int, str, int, list[str], list[str]]] = []
    n = 0
    for (state, ins, act), text in zip(steps, texts, strict=True):
        for x in ins:
            n += 1
            out.append((n, ROLES[x], 0, ["insert"], []))
        if "merge" not in act:
            n += 1
        elif out:
            number, role, turns, acts, held = out[-1]
            out[-1] = (number, role, turns + 1, acts, held)
            acts.append(act)
            held.append(text)
            continue
        out.append((n, ROLES[state], 1, [act], [text]))
    for x in finish(last)[1] if ends else ():
        n += 1
        out.append((n, ROLES[x], 0, ["insert"], []))
    return out


_ROLE = {r: i for i, r in enumerate(ROLES)}
_MADE = ("kind", "conv", "p", "seg", "i", "position", "role", "n_turns", "actions", "text", "m")
DONE, RAW, MATRIX = range(3)


class _Rows:
    """Rows of one schema, given out as batches of a bounded size."""

    def __init__(self, names: tuple[str, ...], types: list[pa.DataType]):
        self.names, self.types, self.rows, self.held = names, types, [], 0

    def add(self, row: tuple, chars: int = 0) -> None:
        self.rows.append(row)
        self.held += 100 + chars

    def full(self) -> bool:
        return self.held > 1 << 23

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(self.names)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types, strict=True)], names=list(self.names))
        self.rows, self.held = [], 0
        return out


def _first_pass(conv: pa.DataType):
    types = [pa.int32(), conv, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole conversations repaired; of the others the turns, with their segment, and its matrices."""
        out, seg, first = _Rows(_MADE, types), 0, True
        key, part, roles, texts, chars, whole = None, 0, [], [], 0, False

        def segment() -> None:
            nonlocal seg, roles, texts, chars
            for i, (r, t) in enumerate(zip(roles, texts, strict=True)):
                out.add((RAW, key, part, seg, i, None, ROLES[r], None, None, t, None), len(t))
            cost, made = zip(*(forward(roles, q) for q in range(4)), strict=True)
            out.add((MATRIX, key, part, seg, None, None, None, None, None, None, np.array([cost, made], np.int64).tobytes()))
            seg, roles, texts, chars = seg + 1, [], [], 0

        def close(last: bool) -> None:
            nonlocal roles, texts, chars
            if not whole or last:  # it may go on beyond this range
                if roles:
                    segment()
                return
            steps, state = _whole_path(tuple(roles)) if len(roles) <= 64 else (path(roles, START, (s := _end(roles))), s)
            for n, role, turns, acts, held in turns_of(steps, texts, state, True):
                text = "\n".join(held)
                out.add((DONE, key, part, None, None, n - 1, role, turns, ",".join(acts), text, None), len(text))
            roles, texts, chars = [], [], 0

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("conv", "p", "role", "text")]
            for k, p, role, text in zip(*columns, strict=True):
                if first or k != key:
                    if not first:
                        close(False)
                    whole = not first
                    key, part, first = k, p, False
                roles.append(_ROLE.get(role, 0))
                texts.append(text)
                chars += len(text)
                if len(roles) >= SEGMENT or chars > SEGMENT_CHARS:
                    segment()
                    whole = False
                if out.full():
                    yield out.batch()
        if not first:
            close(True)
        yield out.batch()

    return run


def _end(roles: list[int]) -> int:
    cost, _ = forward(roles, START)
    return min(range(1, 4), key=lambda q: (cost[q] + finish(q)[0], q))


def _states(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a conversation's segments: the states before and after each and the turns made before it."""
    pdf = pdf.sort_values(["p", "seg"])
    both = [np.frombuffer(m, np.int64).reshape(2, 4, 4) for m in pdf["m"]]
    s = chain([b[0] for b in both])
    made = [int(b[1][x, y]) for b, x, y in zip(both, s, s[1:], strict=False)]
    return pd.DataFrame({"p": pdf["p"], "seg": pdf["seg"], "first": s[:-1], "last": s[1:], "start": np.cumsum([0, *made[:-1]]), "ends": [False] * (len(pdf) - 1) + [True]})


def _second_pass(conv: pa.DataType):
    names = ("conv", "position", "p", "seg", "role", "n_turns", "actions", "text")
    types = [conv, pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repaired turns of segments, or what a segment adds to one."""
        out = _Rows(names, types)
        at, roles, texts = None, [], []

        def close() -> None:
            k, p, seg, first, last, start, ends = at
            for n, role, turns, acts, held in turns_of(path(roles, first, last), texts, last, ends):
                text = "\n".join(held) if held else None
                out.add((k, start + n - 1, p, seg, role, turns, ",".join(acts), text), len(text or ""))

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("conv", "p", "seg", "first", "last", "start", "ends", "role", "text")]
            for *segment, role, text in zip(*columns, strict=True):
                if at is not None and segment[1:3] != at[1:3]:
                    close()
                    roles, texts = [], []
                at = segment
                roles.append(_ROLE.get(role, 0))
                texts.append(text)
                if out.full():
                    yield out.batch()
        if at is not None:
            close()
        yield out.batch()

    return run


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, position, role, n_turns, actions, text, rendered of every repaired turn."""
    spark = turns.sparkSession
    d = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.lower(F.trim("role")), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the number of a row tells only repeated rows apart, which are alike
    order = ["conv", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = d.select(*d.columns, *(c.alias(f"o{i}") for i, c in enumerate(order[3:])))
    order = ["conv", "turn", "role", "o0", "o1", "o2"]
    # a count of its own: the rows are small for the work they make, and would be dealt to few tasks
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts(turns.count(), RANGE))
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv", F.spark_partition_id().alias("p"), "role", "text")
    conv = turns.schema["conv_id"].dataType
    arrow = to_arrow_type(conv)
    name = conv.simpleString()
    made = materialise(dealt.mapInArrow(_first_pass(arrow), f"kind int, conv {name}, p int, seg int, i long, position long, role string, n_turns long, actions string, text string, m binary"), "turns")
    states = made.where(F.col("kind") == MATRIX).select("conv", "p", "seg", "m").groupBy("conv").applyInPandas(_states, "p int, seg int, first int, last int, start long, ends boolean")
    raw = made.where(F.col("kind") == RAW).select("conv", "p", "seg", "i", "role", "text").join(states, ["p", "seg"])
    bits = raw.repartition(n, "p", "seg").sortWithinPartitions("p", "seg", "i").mapInArrow(_second_pass(arrow), f"conv {name}, position long, p int, seg int, role string, n_turns long, actions string, text string")
    bit = F.array_sort(F.collect_list(F.struct("p", "seg", "actions", "text")))
    joined = bits.groupBy("conv", "position").agg(F.min("role").alias("role"), F.sum("n_turns").alias("n_turns"), bit.alias("b"))
    joined = joined.select("conv", "position", "role", "n_turns", F.array_join(F.transform("b", lambda x: x["actions"]), ",").alias("actions"), F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"))
    out = made.where(F.col("kind") == DONE).select(*joined.columns).union(joined).withColumnRenamed("conv", "conv_id")
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n")))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations")).drop("text")
