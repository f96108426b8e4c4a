"""Rows that share an id, or have none, stay rows of their own; odd values and extra columns."""

import random

import numpy as np

from scriptorium.llm import chat, hnsw, topk

V, W = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]


def embeddings(spark, rows):
    return spark.createDataFrame([(i, x, label, "x", 7) for i, x, label in rows], "vec_id long, embedding array<double>, label int, x string, n long")


def test_links_are_counted_by_row(spark):
    d = embeddings(spark, [(1, V, 0), (1, V, 0), (2, W, 0), (None, V, 0), (None, W, 1), (5, W, None), (6, [1e-200, 0.0, 2e-201], 0), (7, [1e300, 0.0, 2e299], 0), (7, W, 0)])
    got = sorted(map(tuple, hnsw.near_duplicates(d).collect()), key=str)
    want = [(1, 4, 1, True), (1, 4, 1, True), (2, 1, 2, True), (None, 4, 1, False), (None, 0, None, True), (5, 0, 5, True), (6, 4, 1, False), (7, 4, 1, False), (7, 1, 2, False)]
    assert got == sorted(want, key=str)


def test_hot_vector_and_shards(spark):
    rng = np.random.default_rng(3)
    rows = [(i, V, 0) for i in range(300)] + [(300 + i, (np.array(V) + rng.normal(size=3) * 0.01).tolist(), 0) for i in range(60)]
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(embeddings(spark, rows), shard=20).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93).sum(1) - 1
    assert [got[i]["n_links"] for i in range(360)] == near.tolist() and {r["component_id"] for r in got.values()} == {0}


def test_topk_by_row(spark):
    d = embeddings(spark, [(50, [1.0, 2.0], 0), (50, [3.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [1e18, 1e18], 0), (None, V, 0), (3, None, 0), (4, [float("inf")], 0), (5, [], 0)])
    got = sorted(map(tuple, topk.search(topk.scaled(d), "vec_id % 50 = 0", 2).collect()))
    assert got == [(50, 1, 2, 2**63 - 1), (50, 1, 2, 2**63 - 1), (50, 2, 1, 3 * 65536), (50, 2, 1, 3 * 65536)]


def test_topk_accumulates_exactly():
    rng = random.Random(2)
    for top in (3, 2**20, 2**45, 2**62):
        q, c = ([[rng.choice([0, 0, rng.randint(-top, top)]) for _ in range(5)] for _ in range(n)] for n in (4, 40))
        got = topk.accumulate(np.array(q, np.int64), np.array(c, np.int64).T)
        assert got.tolist() == [[sum(x * y for x, y in zip(a, b, strict=True)) for b in c] for a in q]


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, position string, seg int")


def test_turns_with_one_number_or_none(spark):
    rows = [(1, None, "user", f"a{i:04d}") for i in range(3000)] + [(1, 1, "assistant", "z"), (2, 5, " User ", None), (2, 5, "user", ""), (2, 5, "user", ""), (3, 1, None, "<|end|>")]
    d = chats(spark, rows).repartition(3)
    small, chat.SEGMENT = chat.SEGMENT, 100
    try:
        got = sorted(map(tuple, chat.repair(d).collect()), key=str)
    finally:
        chat.SEGMENT = small
    want = [
        (1, 0, "user", 3000, ",".join(["keep"] + ["merge"] * 2999), "\n".join(f"a{i:04d}" for i in range(3000))), (1, 1, "assistant", 1, "keep", "z"),
        (2, 0, "user", 3, "keep,merge,merge", "\n\n"), (2, 1, "assistant", 0, "insert", ""),
        (3, 0, "user", 0, "insert", ""), (3, 1, "assistant", 1, "relabel", "<|end|>"),
    ]
    assert [g[:6] for g in got] == want or [g[:6] for g in got] == [*want[:4], (3, 0, "user", 1, "relabel", "<|end|>"), (3, 1, "assistant", 0, "insert", "")]
    assert all(g[6] == f"<|{g[2]}|>\n{g[5]}<|end|>\n" for g in got)
    assert chat.repair(d.where("false")).count() == 0
