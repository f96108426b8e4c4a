"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Every hashed token has a sparse ternary index vector. A token's word vector sums the index
vectors of its neighbours in the whole corpus (random indexing); a document's features pool
the word vectors of all its tokens. A network of one hidden layer, trained in numpy, gives a
logit whose temperature is fitted on rows held back from training.

Defined cases: a null or empty text has zero features and the network's score for them; a
null doc_id is scored, is never learned from and counts as not held out; repeated rows are
scored alike; label rows that contradict each other are not learned from; without labels
of both kinds every score is the share of good labels, or 0.5 without any."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_of, fold, small_batches, sum_arrays, texts
from .textvec import scramble, slices, tokens

BUCKETS, DIM, ONES, WINDOW = 1 << 15, 32, 3, 2
#: The most labelled rows that training reads, those with the smallest hash of their id.
SAMPLE = 20_000
HIDDEN, EPOCHS, SEED = 32, 60, 7
N_FEATURES = 3 * DIM + 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the ONES non-zero entries of every bucket's index vector."""
    h = scramble(np.arange(BUCKETS * ONES, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, ONES)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1).astype(np.int64)


def _cooccurrence(batches):
    """Each task's sum of the neighbours' index vectors, by bucket of the token."""
    at, sign = index_vectors()
    at, size = at + (sign < 0) * BUCKETS * DIM, BUCKETS * DIM
    total = np.zeros(2 * size, np.int64)
    for batch in batches:
        docs = texts(batch)
        for i, j in slices(docs, 2 << 20):
            h, doc = tokens(docs[i:j])
            b = (h % np.uint64(BUCKETS)).astype(np.int64)
            for step in range(1, WINDOW + 1):
                same = doc[step:] == doc[:-step]
                x, y = b[:-step][same], b[step:][same]
                for one, other in ((x, y), (y, x)):
                    total += np.bincount((one[:, None] * DIM + at[other]).ravel(), minlength=2 * size)
    total = total[:size] - total[size:]
    yield from chunks_of(total)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM vectors of unit length from all of `docs`; the size does not depend on them."""
    c = sum_arrays(docs.select("text"), _cooccurrence, BUCKETS * DIM).reshape(BUCKETS, DIM)
    x = np.sign(c) * np.log1p(np.abs(c))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(docs: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Means over a document of its word vectors, their squares and the products of neighbours
    (high where words repeat), the share of tokens equal to the one before, and log length."""
    out = np.zeros((len(docs), N_FEATURES), np.float32)
    for i, j in slices(docs):
        h, doc = tokens(docs[i:j])
        if not len(h):
            continue
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        at, n = doc[first] + i, np.diff(np.append(first, len(doc))).astype(np.float32)
        v = vectors[(h % np.uint64(BUCKETS)).astype(np.int64)]
        near = np.zeros_like(v)
        near[1:] = v[1:] * v[:-1]
        near[first] = 0
        again = np.zeros(len(h), np.float32)
        again[1:] = h[1:] == h[:-1]
        again[first] = 0
        for k, x in enumerate((v, v * v * 4, near * 4)):
            out[at, k * DIM : (k + 1) * DIM] = np.add.reduceat(x, first, axis=0) / n[:, None]
        out[at, 3 * DIM] = np.add.reduceat(again, first) / n
        out[at, 3 * DIM + 1] = np.log1p(n) / 8
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> dict:
    """Two layers by Adam with early stopping by the rows held back; then the temperature."""
    if len(y) == 0 or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    back, use = order[: max(1, len(y) // 5)], order[len(y) // 5 :]
    mean, scale = x[use].mean(0), x[use].std(0) + 1e-4
    z = (x - mean) / scale
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
    m, v, best, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], (np.inf, p), 0
    forward = lambda q, a: np.maximum(a @ q[0] + q[1], 0) @ q[2] + q[3]
    loss = lambda logit, a: float(np.mean(np.logaddexp(0, logit) - a * logit))
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(use), max(1, len(use) // 128)):
            a, b = z[batch], y[batch]
            h = np.maximum(a @ p[0] + p[1], 0)
            g = (_sigmoid(h @ p[2] + p[3]) - b) / len(b)
            back_h = np.outer(g, p[2]) * (h > 0)
            t += 1
            for k, d in enumerate((a.T @ back_h, back_h.sum(0), h.T @ g, np.array([g.sum()]))):
                d = d + 1e-4 * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        now = loss(forward(p, z[back]), y[back])
        if now < best[0]:
            best = (now, [a.copy() for a in p])
    p = best[1]
    logit = forward(p, z[back])
    warm = min(np.exp(np.linspace(-1.5, 2.5, 161)), key=lambda s: loss(logit / s, y[back]))
    return {"mean": mean, "scale": scale, "p": p, "temperature": float(warm)}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    p = model["p"]
    h = np.maximum((x - model["mean"]) / model["scale"] @ p[0] + p[1], 0)
    return _sigmoid((h @ p[2] + p[3]) / model["temperature"])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> tuple[np.ndarray, dict]:
    """(word vectors, network). Labels are read only from rows whose crc32 modulo `folds` is not `held`."""
    vectors = word_vectors(docs)
    known = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), folds) != held)).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    known = known.select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    # a hash threshold leaves somewhat more than the sample, so that no task sorts all labels
    part = min(1.0, (1.2 * sample + 1000) / max(1, known.count()))
    known = known.where(F.col("h") / 2.0**64 + 0.5 <= part).orderBy("h", "doc_id").limit(sample).select("doc_id", "y")

    def rows(batches):
        for b in batches:
            x = features(texts(b), vectors)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "y": b.column("y"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    # bounded: at most `sample` rows
    got = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(rows, "doc_id long, y int, x binary").collect()
    got.sort(key=lambda r: r["doc_id"])
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float64).reshape(-1, N_FEATURES)
    return vectors, train(x, np.array([r["y"] for r in got], np.float64))


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of every row of `docs` with its quality `score` in 0 to 1 and `predicted` 0 or 1."""
    small_batches(docs.sparkSession)
    vectors, model = fit(docs, labels, folds, held)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))
    fields = [f for f in docs.schema.fields if f.name in columns]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double", "predicted int"])

    text = "text" if "text" in columns else "__text"

    def run(batches):
        vectors, model = shared.value
        for b in batches:
            s = predict(model, features(texts(b, text), vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*(f.name for f in fields), "score", "predicted"])

    return docs.select(*(f.name for f in fields), *([] if text == "text" else [F.col("text").alias(text)])).mapInArrow(run, schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
