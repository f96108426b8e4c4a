"""Mixing sources to target weights by Pfair scheduling.

Target weights are rounded to multiples of 1/PERIOD, so that the schedule repeats after
PERIOD slots. In one period a source of c slots has blocks k = 0 .. c-1, block k released at
floor(k * PERIOD / c) with deadline ceil((k + 1) * PERIOD / c); each slot goes to the
released block with the earliest deadline. On one processor that meets every deadline, so a
source never is a whole block ahead of or behind its target. The period's slots are a table
of PERIOD rows; a document's slot follows from its place in its source by arithmetic.

Without a target, the one schedule is that of the sources' exact shares described below.

The schedule of the target ends with the last slot before some source would run dry. All
rows beyond it, of sources without a target too, follow in a second schedule that weights
each source by its remaining rows. Its blocks are the slots of a single period that is as
long as the rest, so no share is rounded and all sources end together. Blocks have the same
size however large the table is. One task makes that schedule from the sources' counts and
streams it, one row for each slot; the slots meet the documents' ranges in joins. Every row
has a position.

Defined cases: a null source is a source of its own, named ''; empty and null texts count as
documents; repeated rows, or rows with one id or none, are documents each; places in a source
go by a hash of the id, of rows without one by a hash of the row's number; sources without a target, or with one of zero, come after the target's schedule;
targets of sources without rows are left out; with a `cap` for more than SOURCES sources, the
smallest are scheduled together as one; an empty table gives no rows; texts are not read, however long, nor
are extra columns but those asked for."""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, table

PERIOD, BLOCK, CAP = 1024, 8, 0.25
#: The longest period that grows for a small target.
LONGEST = 1 << 17
#: Rows that one task ranks together, about.
GROUP = 4096
#: The most sources that a cap tells apart; their counts are collected.
SOURCES = 100_000


def capped_weights(sizes: dict[str, int], cap: float = CAP) -> dict[str, float]:
    """Each source's share of the rows, none above `cap` (or an even share, if that is more)."""
    names, total = sorted(sizes), sum(sizes.values())
    cap = max(cap, 1 / max(1, len(names)))
    w = {s: sizes[s] / total for s in names}
    fixed: set[str] = set()
    while True:
        over = [s for s in names if s not in fixed and w[s] > cap + 1e-12]
        if not over:
            return w
        fixed.update(over)
        rest = sum(sizes[s] for s in names if s not in fixed)
        for s in names:
            w[s] = cap if s in fixed else (1 - cap * len(fixed)) * sizes[s] / rest


def slots_of(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots of a period by largest remainders; a source with a weight gets one at least."""
    names = sorted(s for s in weights if weights[s] > 0)
    total = sum(weights[s] for s in names)
    exact = {s: weights[s] / total * period for s in names}
    out = {s: max(1, int(exact[s])) for s in names}
    by = sorted(names, key=lambda s: (out[s] - exact[s], s))
    k = 0
    while (left := period - sum(out.values())) != 0:
        if left > 0:
            out[by[k % len(by)]] += 1
        else:
            out[max(names, key=lambda s: (out[s], s))] -= 1
        k += 1
    return out


def runs_of(slots: dict[str, int], period: int):
    """(source, first block within the period, first slot, blocks) by earliest deadline first among released blocks.

    A source's blocks in slots on end come as one run, so that a source with most of the slots costs little."""
    waiting = [(0, s, 0) for s in sorted(slots)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    t = 0
    while t < period:
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // slots[s]), s, k))
        deadline, s, k = heapq.heappop(ready)
        if deadline < t + 1:
            raise AssertionError("a deadline was missed")
        c = slots[s]
        more = c - 1 - k  # as long as its next block is released, and none of another source comes first
        if waiting:
            more = min(more, waiting[0][0] - t - 1)
        if c < period:
            more = min(more, ((t + 1) * c - k * period - 1) // (period - c))
        if ready:
            latest = ready[0][0] - (s > ready[0][1])
            more = min(more, latest * c // period - k - 1)
        n = 1 + max(0, more)
        yield s, k, t, n
        k, t = k + n, t + n
        if k < c:
            heapq.heappush(waiting, (k * period // c, s, k))


def period_of(slots: dict[str, int], period: int) -> list[tuple[str, int, int]]:
    """(source, block within the period, slot) of one period."""
    return [(s, k + i, t + i) for s, k, t, n in runs_of(slots, period) for i in range(n)]


def turns(sizes: dict[str, int], block: int):
    """(source, first block, first slot, first position, source's blocks, blocks) of the runs of a schedule of all rows by their sources' shares."""
    slots = {s: -(-n // block) for s, n in sizes.items() if n > 0}
    start = 0
    for s, k, t, n in runs_of(slots, sum(slots.values())):
        yield s, k, t, start, slots[s], n
        start += min(n * block, sizes[s] - k * block)


def whole(sizes: dict[str, int], block: int) -> tuple[int, list[tuple[str, int, int, int, int, int]]]:
    """The block's size, which no table changes, and all `turns`."""
    return block, list(turns(sizes, block))


def _scheduled(block: int, rows: int = 1 << 16):
    """From (source, n): (source, later, turn, due, first) of every block of the schedule of all n rows, streamed."""

    def run(batches):
        sizes = {s: n for b in batches for s, n in zip(b.column("source").to_pylist(), b.column("n").to_pylist(), strict=True)}
        total = sum(-(-n // block) for n in sizes.values())
        held, size = [], 0

        def batch():
            names, k, t, start, c, n = zip(*held, strict=True)
            n = np.array(n, np.int64)
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(np.arange(len(n)), n)
            later = np.array(k, np.int64)[at] + i
            # whole numbers of any size
            due = [-(-(x + 1) * total // c[j]) for x, j in zip(later.tolist(), at.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(at)), pa.array(later), pa.array(np.array(t, np.int64)[at] + i), pa.array(due, pa.int64()), pa.array(np.array(start, np.int64)[at] + i * block)],
                ["source", "later", "turn", "due", "first"],
            )

        for s, k, t, start, c, n in turns(sizes, block):
            for j in range(0, n, rows):  # a long run comes in several parts
                held.append((s, k + j, t + j, start + j * block, c, min(rows, n - j)))
                size += held[-1][-1]
                if size >= rows:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    return run


def ranked(docs: DataFrame, columns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(source, range, h, doc_id, number (from 1) in the range and `columns` of each row; source, range, n, start of each range).

    Rows of a source fall into ranges of their hash, without a task for a whole source; a row's
    place in its source is its number in the range after the sizes of the ranges before it."""
    ranges = parts(docs.count(), GROUP)
    # rows without an id may be many, and go by their number
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id"))
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), h.alias("h"), *columns)
    # monotone in the hash, so that ranges follow each other
    d = d.withColumn("range", F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * ranges), F.lit(ranges - 1)).cast("int"))
    sizes = d.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source", "range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("source", "range").orderBy("h", "doc_id"))
    return d.withColumn("number", number), starts


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, cap: float | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, place, block, slot, deadline, position and `columns` of every row of `docs`.

    Every row has a position; block, slot and deadline are null for rows beyond the target's
    schedule. `weights` are the sources' targets; with only `cap` they are the sources' own
    shares, none above it. Without either the target is the sources' exact shares, and its
    schedule holds every row."""
    spark = docs.sparkSession
    own = weights is None and cap is None
    sizes: dict[str, int] = {}
    if not own:
        by = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).count()
        by = by.where(F.col("source").isin(list(weights))) if weights is not None else by.orderBy(F.desc("count"), "source").limit(SOURCES + 1)
        sizes = {r[0]: r[1] for r in by.collect()}
        if weights is None and len(sizes) > SOURCES:
            return _pooled(docs, list(sizes)[: SOURCES - 1], block, cap, columns)
        weights = weights if weights is not None else capped_weights(sizes, cap) if sizes else {}
    period = PERIOD
    use = {s: w for s, w in (weights or {}).items() if w > 0 and sizes.get(s, 0) > 0}
    while period < 4 * len(use) or (use and period < LONGEST and period * min(use.values()) < sum(use.values())):
        period *= 2
    slots = slots_of(use, period) if use else {}
    # the last whole slot at which every source still has a block for each slot due to it
    supply = {s: max(1, sizes[s] // block) for s in slots}
    plan = period_of(slots, period) if slots else []
    at = {(s, k): t for s, k, t in plan}
    end = min(((supply[s] // c) * period + at[s, supply[s] % c] for s, c in slots.items()), default=0)
    taken = dict.fromkeys(slots, 0)
    for s, _, t in plan:
        taken[s] += block * (end // period + (t < end % period))
    steps = spark.createDataFrame(plan, "source string, k int, t int")  # `period` rows
    counts = spark.createDataFrame([(s, slots[s], min(sizes[s], n)) for s, n in taken.items()], "source string, c int, taken long")  # one for each target
    d, starts = ranked(docs, columns)
    taken = F.coalesce("taken", F.lit(0))
    starts = starts.join(F.broadcast(counts), "source", "left").select("source", "range", "n", "start", "c", taken.alias("taken"))
    # the schedule of all other rows, by one task; each range gets the blocks that its rows fall into
    rest = starts.groupBy("source").agg((F.sum("n") - F.first("taken")).alias("n"))
    after = rest.repartition(1).mapInArrow(_scheduled(block), "source string, later long, turn long, due long, first long")
    first, last = F.greatest(F.col("start") - F.col("taken"), F.lit(0)), F.col("start") + F.col("n") - 1 - F.col("taken")
    first, last = F.floor(first / block), F.floor(last / block)
    needed = starts.where(F.col("start") + F.col("n") > F.col("taken")).select("source", "range", F.explode(F.sequence(first, last)).alias("later"))
    lists = needed.join(after, ["source", "later"]).groupBy("source", "range").agg(F.sort_array(F.collect_list(F.struct("later", "turn", "due", "first"))).alias("after"))
    d = d.join(starts.join(lists, ["source", "range"], "left"), ["source", "range"])
    d = d.withColumn("place", F.col("start") + F.col("number") - 1).withColumn("block", F.floor(F.col("place") / block))
    over = F.col("place") - F.col("taken")
    inside, later = over < 0, F.floor(over / block)
    turn = F.when(~inside, F.get("after", (later - F.get("after", F.lit(0))["later"]).cast("int")))
    if own:
        at_block, slot, deadline = later, turn["turn"], turn["due"]
        position = turn["first"] + over % block
    else:
        d = d.withColumn("k", (F.col("block") % F.col("c")).cast("int")).join(F.broadcast(steps), ["source", "k"], "left")
        at_block, slot = F.col("block"), F.floor(F.col("block") / F.col("c")) * period + F.col("t")
        deadline = F.ceil((F.col("block") + 1) * F.lit(period) / F.col("c"))
        position = F.when(inside, slot * block + F.col("place") % block).otherwise(F.lit(end * block) + turn["first"] + over % block)
        at_block, slot, deadline = (F.when(inside, x) for x in (at_block, slot, deadline))
    return d.select(
        "doc_id", "source", F.col("place").cast("long"), at_block.cast("long").alias("block"), slot.cast("long").alias("slot"), deadline.cast("long").alias("deadline"), position.cast("long").alias("position"), *columns,
    )


def _pooled(docs: DataFrame, apart: list[str], block: int, cap: float, columns: tuple[str, ...]) -> DataFrame:
    """A mix in which all sources but `apart` are scheduled as one, in the order of their rows' hashes."""
    pool = uuid.uuid4().hex
    own = docs.sparkSession.createDataFrame([(s, s) for s in apart], "__real string, __lane string")  # SOURCES rows
    d = docs.withColumn("__real", F.coalesce("source", F.lit(""))).join(F.broadcast(own), "__real", "left").withColumn("source", F.coalesce("__lane", F.lit(pool)))
    out = mix(d, None, block, cap, (*columns, "__real"))
    return out.select(*(F.col("__real").alias("source") if c == "source" else c for c in out.columns if c != "__real"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
