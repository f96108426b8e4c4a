"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Equal vectors of a label are one node with a count. Nodes of one label fall into shards of a
bounded size; each shard gets a graph of several layers, built in numpy by inserting growing
batches. Every vector queries every shard of its label, its own from its own place too: greedy
descent, then a beam on the lowest layer, then the neighbours of what it found as long as that
finds more. Two shards meet in one task, which queries either's graph with the other's vectors.
Candidates are verified by cosine in double precision. A recall audit searches some queries
exhaustively, for their links and for nearest neighbours somewhat below the threshold; beams double until the audit passes,
and a shard where the widest beam does not pass, or a query whose beam is full of links, is
searched exhaustively. Links are counted where they are found, and only a spanning set of them
leaves a task; components come from table operations.

Defined cases: a vector that is null, zero or holds null or non-finite components, or has no
label, is a component of its own without links, and so is any vector alone in its label;
vectors of different lengths do not link; components however small or large count by their
direction; rows with one vec_id, or none, are rows of their own, which link like any others, and
a component's id is its smallest vec_id that is not null; long vectors are held whole; extra
columns are not read, whatever their names; an empty table gives no rows."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .components import components
from .textvec import scramble

#: Vectors in a shard, at most about.
SHARD = 8192
LINKS, BUILD_BEAM, FIRST_BEAM, WIDEST_BEAM = 12, 16, 16, 128
#: Queries that an audit searches exhaustively, as many again among those that found something
#: near, the share of their nearest neighbours to be found, and how much farther than a link
#: those may be.
AUDIT, RECALL, MARGIN = 64, 0.9, 4
THRESHOLD = 0.93


class Layer:
    """A graph over rows `ids` of the shard: adjacency of at most 2 * LINKS, padded with -1."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.near = np.full((len(ids), 2 * LINKS), -1, np.int32)
        self.sim = np.full((len(ids), 2 * LINKS), -np.inf, np.float32)

    def link(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        """Offer edges a-b of similarity s: every row keeps its nearest distinct ones."""
        rows = np.unique(a)
        at, k = np.nonzero(self.near[rows] >= 0)
        a, b, s = np.append(a, rows[at]), np.append(b, self.near[rows[at], k]), np.append(s, self.sim[rows[at], k])
        _, first = np.unique(a * len(self.ids) + b, return_index=True)
        first = first[a[first] != b[first]]
        a, b, s = a[first], b[first], s[first]
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < self.near.shape[1]
        self.near[rows], self.sim[rows] = -1, -np.inf
        self.near[a[keep], rank[keep]], self.sim[a[keep], rank[keep]] = b[keep], s[keep]


def beam(x: np.ndarray, layer: Layer, q: np.ndarray, entry: np.ndarray, width: int, filled: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, similarities) of the `width` nearest found for each query, best first; -1 pads.

    All queries advance together: each step expands the two best candidates of every query
    that are not expanded yet."""
    n, m = len(layer.ids) if filled is None else filled, len(q)
    width = min(width, n)
    pos = np.full((m, width), -1, np.int32)
    sim = np.full((m, width), -np.inf, np.float32)
    done = np.ones((m, width), bool)
    seen = np.zeros((m, n), bool)
    rows = np.arange(m)
    k = min(entry.shape[1], width)
    entry = entry[:, :k]
    ok = entry >= 0
    pos[:, :k] = entry
    sim[:, :k] = np.where(ok, np.einsum("mkd,md->mk", x[layer.ids[entry]], q), -np.inf)
    done[:, :k] = ~ok
    seen[rows[:, None], np.where(ok, entry, entry[:, :1])] = True
    while True:
        score = np.where(done, -np.inf, sim)
        best = np.argpartition(-score, min(1, width - 1), axis=1)[:, :2]
        live = np.flatnonzero(np.isfinite(np.take_along_axis(score, best, 1)).any(1))
        if not len(live):
            break
        b = best[live]
        fresh = np.isfinite(score[live[:, None], b])
        done[live[:, None], b] = True
        near = layer.near[np.where(fresh, pos[live[:, None], b], 0)]
        near = np.where(fresh[:, :, None], near, -1).reshape(len(live), -1)
        ok = near >= 0
        near = np.where(ok, near, 0)
        ok &= ~seen[live[:, None], near]
        order = np.argsort(near, axis=1, kind="stable")
        s = np.take_along_axis(near, order, 1)
        same = np.zeros(s.shape, bool)
        same[:, 1:] = s[:, 1:] == s[:, :-1]
        twice = np.zeros(s.shape, bool)
        np.put_along_axis(twice, order, same & np.take_along_axis(ok, np.roll(order, 1, 1), 1), 1)
        ok &= ~twice
        r, c = np.nonzero(ok)
        seen[live[r], near[r, c]] = True
        new = np.full(near.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("nd,nd->n", x[layer.ids[near[r, c]]], q[live[r]])
        all_sim = np.concatenate([sim[live], new], 1)
        top = np.argpartition(-all_sim, width - 1, axis=1)[:, :width]
        sim[live] = np.take_along_axis(all_sim, top, 1)
        pos[live] = np.take_along_axis(np.concatenate([pos[live], near.astype(np.int32)], 1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, bool)], 1), top, 1) | ~np.isfinite(sim[live])
    order = np.argsort(-sim, axis=1, kind="stable")
    sim = np.take_along_axis(sim, order, 1)
    return np.where(np.isfinite(sim), np.take_along_axis(pos, order, 1), -1), sim


def build(x: np.ndarray) -> list[Layer]:
    """Layers from the lowest up; a row rises one layer with chance 1 / LINKS, by a hash of its place."""
    n = len(x)
    u = (scramble(np.arange(n, dtype=np.uint64) + np.uint64(99)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    height = np.floor(-np.log(u + 1e-18) / np.log(LINKS)).astype(int)
    layers = []
    for h in range(int(height.max(initial=0)) + 1):
        ids = np.flatnonzero(height >= h)
        if h and len(ids) < 2:
            break
        layers.append(Layer(ids))
    for layer in layers:
        at = 0
        m = len(layer.ids)
        while at < m:
            size = min(max(32, at // 2), 1024, m - at)
            new = np.arange(at, at + size)
            q = x[layer.ids[new]]
            s = q @ q.T
            np.fill_diagonal(s, -np.inf)
            k = min(LINKS, size - 1)
            own = np.argpartition(-s, max(k - 1, 0), axis=1)[:, :k] if k else np.zeros((size, 0), int)
            a, b, sim = np.repeat(new, k), own.ravel() + at, np.take_along_axis(s, own, 1).ravel()
            if at:
                start = np.tile(scramble(np.arange(4, dtype=np.uint64)).astype(np.uint64) % np.uint64(at), (size, 1)).astype(np.int64)
                old, near = beam(x, layer, q, start, BUILD_BEAM, at)
                r, c = np.nonzero(old[:, :LINKS] >= 0)
                a, b, sim = np.append(a, new[r]), np.append(b, old[r, c]), np.append(sim, near[r, c])
            layer.link(np.append(a, b), np.append(b, a), np.append(sim, sim).astype(np.float32))
            at += size
    return layers


def search(x: np.ndarray, layers: list[Layer], q: np.ndarray, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the shard nearest to each query, found from the top layer down; `own` are the queries' own rows, if they are in the shard."""
    top = layers[-1]
    entry = np.zeros((len(q), 1), np.int64)
    for h in range(len(layers) - 1, -1, -1):
        layer = layers[h]
        if h == 0:
            # the lowest layer also starts at a few fixed rows, which helps where it is not connected
            fixed = scramble(np.arange(3, dtype=np.uint64)) % np.uint64(len(layer.ids))
            entry = np.concatenate([entry, np.tile(fixed.astype(np.int64), (len(q), 1)), *([] if own is None else [own[:, None]])], 1)
            s = np.sort(entry, 1)
            entry = np.where(np.concatenate([np.zeros((len(q), 1), bool), s[:, 1:] == s[:, :-1]], 1), -1, s)
            entry = np.take_along_axis(entry, np.argsort(-entry, axis=1, kind="stable"), 1)
            return beam(x, layer, q, entry, width)
        pos, _ = beam(x, layer, q, entry, 4)
        below = np.searchsorted(layers[h - 1].ids, layer.ids[np.maximum(pos, 0)])
        entry = np.where(pos >= 0, below, -1)
    raise AssertionError(top)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit rows, in double precision, by the same order of additions for either argument order."""
    return np.einsum("nd,nd->n", a, b)


def exhaustive(unit: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs at or over the threshold."""
    out_q, out_r = [], []
    for i in range(0, len(q), 512):
        a, b = np.nonzero(q[i : i + 512] @ unit.T >= threshold - 1e-9)
        keep = _cosines(q[a + i], unit[b]) >= threshold
        out_q.append(a[keep] + i)
        out_r.append(b[keep])
    return (np.concatenate(out_q), np.concatenate(out_r)) if out_q else (np.zeros(0, int), np.zeros(0, int))


def links(unit: np.ndarray, layers: list[Layer], q: np.ndarray, threshold: float = THRESHOLD, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs at or over the threshold, through the graph; see the module for audits.

    With `same` the queries are the shard's own rows, which do not link with themselves."""
    x, q32 = unit.astype(np.float32), q.astype(np.float32)
    n, found, width = len(unit), np.zeros(0, np.int64), FIRST_BEAM
    base = layers[0]
    margin = 1 - MARGIN * (1 - threshold)
    closest = np.full(len(q), -np.inf)
    audit = want = whole = None
    todo, full = np.arange(len(q)), np.zeros(0, np.int64)
    while len(todo):
        for i in range(0, len(todo), 512):
            rows = todo[i : i + 512]
            pos, sim = search(x, layers, q32[rows], width, rows if same else None)
            ok = pos >= 0
            if same:
                ok &= base.ids[pos] != rows[:, None]
            closest[rows] = np.where(ok, sim, -np.inf).max(1)
            r, c = np.nonzero(ok)
            cand = rows[r] * n + base.ids[pos[r, c]]
            good = np.unique(cand[_cosines(q[cand // n], unit[cand % n]) >= threshold])
            # a beam full of links may have left some out
            many = np.bincount(np.searchsorted(rows, good // n), minlength=len(rows)) >= min(width, n) - same
            full = np.append(full, rows[many])
            good = good[~many[np.searchsorted(rows, good // n)]]
            new = good
            while len(new):  # neighbours of what was found, as long as they link too
                near = base.near[new % n]
                a, b = np.nonzero(near >= 0)
                cand = np.setdiff1d(np.unique(new[a] // n * n + near[a, b]), good)
                if same:
                    cand = cand[cand // n != cand % n]
                new = cand[_cosines(q[cand // n], unit[cand % n]) >= threshold]
                good = np.union1d(good, new)
            found = np.union1d(found, good)
        todo = np.setdiff1d(todo, full)
        if audit is None:
            spread = lambda ids: ids[np.unique(np.linspace(0, len(ids) - 1, min(AUDIT, len(ids))).astype(int))]
            audit = np.union1d(spread(np.arange(len(q))), spread(np.flatnonzero(closest >= margin)))
            whole = q[audit] @ unit.T
            if same:
                whole[np.arange(len(audit)), audit] = -np.inf
            r, c = np.nonzero(whole >= threshold - 1e-9)
            want = audit[r] * n + c
            want = want[_cosines(q[want // n], unit[want % n]) >= threshold]
            whole = whole.max(1)
        missed = np.setdiff1d(want[np.isin(want // n, todo)], found)
        near = np.isin(audit, todo) & (whole >= margin)
        if not len(missed) and (closest[audit] >= whole - 1e-5)[near].sum() >= RECALL * near.sum():
            break
        if width >= WIDEST_BEAM:
            full = np.append(full, todo)
            break
        width *= 2
    if len(full):
        full = np.unique(full)
        a, b = exhaustive(unit, q[full], threshold)
        more = full[a] * n + b
        found = np.union1d(found[~np.isin(found // n, full)], more[more // n != more % n] if same else more)
    return found // n, found % n


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id it reaches) over the links a-b of one task."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    parent = np.arange(len(ids))
    while True:
        ru, rv = parent[u], parent[v]
        if (ru == rv).all():
            break
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[moved], ids[parent[moved]]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither tiny nor huge components are lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build_shard(pdf):
    import pandas as pd

    unit = _unit(np.array(pdf["x"].tolist(), np.float64))
    layers = build(unit.astype(np.float32))
    shapes = np.array([len(y.ids) for y in layers])
    body = _pack(id=pdf["rep"].to_numpy(np.int64), n=pdf["n"].to_numpy(np.int64), unit=unit, shapes=shapes, ids=np.concatenate([y.ids for y in layers]).astype(np.int32), near=np.concatenate([y.near for y in layers]))
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "body": [body]})


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Layer]]:
    z = np.load(io.BytesIO(body))
    ids, near = z["ids"], z["near"]
    layers, at = [], 0
    for m in z["shapes"]:
        layer = Layer(ids[at : at + m])
        layer.near = near[at : at + m]
        layers.append(layer)
        at += m
    return z["id"], z["n"], z["unit"], layers


def _meet(left: bytes, right: bytes, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, n, b): the count n of rows that node a links with (b is a then), and spanning links a-b (n is 0)."""
    ids, n, unit, layers = _unpack(left)
    others, m, unit2, layers2 = (ids, n, unit, layers) if same else _unpack(right)
    a, b = links(unit2, layers2, unit, threshold, same)
    # either end may have found a link
    c, d = (b, a) if same else links(unit, layers, unit2, threshold)[::-1]
    both = np.unique(np.concatenate([a * len(others) + b, c * len(others) + d]))
    a, b = both // len(others), both % len(others)
    sums = [(ids, np.bincount(a, weights=m[b], minlength=len(ids)))]
    if not same:
        sums.append((others, np.bincount(b, weights=n[a], minlength=len(others))))
    nodes, count = (np.concatenate(x) for x in zip(*sums, strict=True))
    keep = count > 0
    u, v = _spanning(ids[a], others[b])
    return np.append(nodes[keep], u), np.append(count[keep].astype(np.int64), np.zeros(len(u), np.int64)), np.append(nodes[keep], v)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `embeddings`."""
    import pandas as pd

    spark = embeddings.sparkSession
    d = F.col("embedding").cast("array<double>")
    good = F.forall(d, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(d, lambda v: v != 0) & F.col("label").isNotNull()
    rows = embeddings.select("vec_id", "label", F.when(good, d).alias("x"), F.monotonically_increasing_id().alias("row"))
    equal = materialise(rows.where("x is not null").groupBy("label", "x").agg(F.min("row").alias("rep"), F.count("*").alias("n"), F.min("vec_id").alias("least")), "vectors")
    v = equal.select("rep", "n", "label", F.size("x").alias("dim"), "x")
    sizes = v.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("shards"))
    v = v.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    kind = embeddings.schema["label"].dataType.simpleString()
    graphs = materialise(v.drop("shards").groupBy("label", "dim", "shard").applyInPandas(_build_shard, f"label {kind}, dim int, shard int, body binary"), "graphs")
    left = graphs.select("label", "dim", F.col("shard").alias("s"), F.col("body").alias("left"))
    pairs = left.join(graphs.withColumnRenamed("body", "right"), ["label", "dim"]).where("s <= shard")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        a, n, b = _meet(r["left"], r["right"], r["s"] == r["shard"], threshold)
        return pd.DataFrame({"a": a, "n": n, "b": b})

    found = materialise(pairs.groupBy("label", "dim", "s", "shard").applyInPandas(meet, "a long, n long, b long"), "links")
    degree = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    comp = components(found.where("a <> b").select("a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    node = equal.join(degree, "rep", "left").join(comp, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = node.groupBy("root").agg(F.min("least").alias("component_id"))
    node = node.join(least, "root").select(F.col("label").alias("l"), F.col("x").alias("y"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(node, (rows["label"] == node["l"]) & (rows["x"] == node["y"]), "left")
    linked = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), linked.alias("component_id"), F.col("vec_id").eqNullSafe(linked).alias("kept"))


def op3_hnsw(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
