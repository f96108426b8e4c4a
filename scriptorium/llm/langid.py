"""Language identification by a bidirectional gated recurrent network over bytes.

The bytes of a text in lower case fall into windows of WINDOW bytes one after another, spaces and signs included. Over
each window a forward and a backward GRU run byte by byte, across word ends, and a softmax labels
every position that belongs to a letter. A document's probability of a language is the mean over
all its labelled positions, in the whole text. The network is trained in numpy by
backpropagation through time, on all windows of a bounded sample of rows.

Defined cases: a null text or one without letters (Unicode category L) is `und` with score 0; a
null lang is never learned from; a null doc_id is predicted, never learned from and not held
out; with no learnable language everything is `und`; ties go to the language first in order;
repeated rows are predicted alike; an empty table gives no rows; a very long text goes through
the network a bounded number of windows at a time; extra columns are not read, but those asked
for are carried along."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, small_batches, table

WINDOW, HIDDEN = 64, 16
#: Training reads at most this many rows in all, an equal share for each language and one at least.
SAMPLE_DOCS = 400
EPOCHS, BATCH, SEED = 2, 128, 11
UND = "und"
PAD = 256
#: Windows that go through the network together.
TOGETHER = 2048
_BMP = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)])


def letters(text: str) -> np.ndarray:
    """Which bytes of a text's UTF-8 belong to letters."""
    if text.isascii():
        return _BMP[np.frombuffer(text.encode("ascii"), np.uint8)]
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _BMP[np.minimum(code, 0xFFFF)]
    for i in np.flatnonzero(code > 0xFFFF).tolist():
        is_letter[i] = unicodedata.category(chr(code[i]))[0] == "L"
    return np.repeat(is_letter, 1 + (code > 0x7F) + (code > 0x7FF).astype(int) + (code > 0xFFFF))


def arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, labelled, text number) of all windows of `texts`; PAD fills the last window of each."""
    texts = [t.lower() for t in texts]
    raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    n = np.array([-(-len(r) // WINDOW) for r in raw], np.int64)
    x, on = np.full(int(n.sum()) * WINDOW, PAD, np.int64), np.zeros(int(n.sum()) * WINDOW, bool)
    for r, t, at in zip(raw, texts, ((np.cumsum(n) - n) * WINDOW).tolist(), strict=True):
        x[at : at + len(r)] = r
        on[at : at + len(r)] = letters(t)
    return x.reshape(-1, WINDOW), on.reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), n)


def _softsign(x):
    """x / (1 + |x|), in place of tanh, and halved and shifted in place of the logistic function: it needs no exponentials."""
    return x / (1 + np.abs(x))


def start(n_langs: int, rng) -> dict[str, np.ndarray]:
    p = {"out": rng.normal(0, 0.2, (2 * HIDDEN, n_langs)), "out_b": np.zeros(n_langs)}
    for d in "fb":
        p[f"e{d}"] = rng.normal(0, 0.3, (257, 3 * HIDDEN))  # what each byte adds to the gates and the candidate
        p[f"u{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
    return {k: v.astype(np.float32) for k, v in p.items()}


def run_direction(p: dict, d: str, x: np.ndarray, keep: bool):
    """Hidden states of one direction (n x width x HIDDEN); what backpropagation needs, if kept.

    A pad leaves the state as it is: zero before a backward run's first byte."""
    n, width = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((n, width, HIDDEN), np.float32)
    trace = []
    e, u = p[f"e{d}"], p[f"u{d}"]
    for t in range(width) if d == "f" else range(width - 1, -1, -1):
        a = e[x[:, t]]
        gates = (1 + _softsign(a[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])) / 2
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        rh = r * h
        c = _softsign(a[:, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
        live = (x[:, t] < 256)[:, None]
        new = np.where(live, h + z * (c - h), h)
        if keep:
            trace.append((t, h, z, r, rh, c, live))
        h = new
        out[:, t] = h
    return out, trace


def pooled(p: dict, x: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Each window's probabilities of the languages, summed over its labelled positions."""
    n, width = x.shape
    steps = np.ascontiguousarray(x.T)
    whole = steps.max(1) < PAD  # steps without a pad
    logits = np.empty((width, n, len(p["out_b"])), np.float32)
    total = np.zeros((n, len(p["out_b"])), np.float32)
    held, half = np.empty((n, 2 * HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32)
    for d in "fb":
        e, u, out = p[f"e{d}"], p[f"u{d}"], p["out"][:HIDDEN] if d == "f" else p["out"][HIDDEN:]
        u_gates, u_new = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :] / 2)
        e_gates, e_new = np.ascontiguousarray(e[:, : 2 * HIDDEN]), np.ascontiguousarray(e[:, 2 * HIDDEN :])
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            gates = e_gates.take(steps[t], 0)
            gates += np.matmul(h, u_gates, out=held)
            np.abs(gates, out=held)
            held += 1
            gates /= held
            gates += 1  # twice the gates
            new = e_new.take(steps[t], 0)
            new += np.multiply(gates[:, HIDDEN:], h, out=half) @ u_new
            np.abs(new, out=half)
            half += 1
            new /= half
            new -= h
            new *= np.multiply(gates[:, :HIDDEN], 0.5, out=half)
            if not whole[t]:
                new[steps[t] == PAD] = 0
            h += new
            if d == "f":
                np.add(h @ out, p["out_b"], out=logits[t])
            else:
                q = logits[t] + h @ out
                q -= q.max(1, keepdims=True)
                np.exp(q, out=q)
                q *= (on[:, t] / q.sum(1))[:, None].astype(np.float32)
                total += q
    return total


def gradient(p: dict, x: np.ndarray, on: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean cross-entropy over labelled positions, by backpropagation through time."""
    g = {k: np.zeros_like(v) for k, v in p.items()}
    f, tf = run_direction(p, "f", x, True)
    b, tb = run_direction(p, "b", x, True)
    both = np.concatenate([f, b], 2)
    logit = both @ p["out"] + p["out_b"]
    q = np.exp(logit - logit.max(2, keepdims=True))
    q /= q.sum(2, keepdims=True)
    q[np.arange(len(y)), :, y] -= 1
    q *= (on / max(1, on.sum()))[:, :, None].astype(np.float32)
    g["out"] = both.reshape(-1, 2 * HIDDEN).T @ q.reshape(-1, q.shape[2])
    g["out_b"] = q.sum((0, 1))
    back = q @ p["out"].T
    for d, trace, dh_all in (("f", tf, back[:, :, :HIDDEN]), ("b", tb, back[:, :, HIDDEN:])):
        u, dh, into = p[f"u{d}"], np.zeros((len(y), HIDDEN), np.float32), []
        for t, h, z, r, rh, c, live in reversed(trace):
            dh = dh + dh_all[:, t]
            on_dh = np.where(live, dh, 0)
            dc = on_dh * z * (1 - np.abs(c)) ** 2
            dz = on_dh * (c - h) * (1 - np.abs(2 * z - 1)) ** 2 / 2
            drh = dc @ u[:, 2 * HIDDEN :].T
            dr = drh * h * (1 - np.abs(2 * r - 1)) ** 2 / 2
            gates = np.concatenate([dz, dr], 1)
            g[f"u{d}"][:, : 2 * HIDDEN] += h.T @ gates
            g[f"u{d}"][:, 2 * HIDDEN :] += rh.T @ dc
            into.append((x[:, t], np.concatenate([gates, dc], 1)))
            dh = np.where(live, dh * (1 - z), dh) + gates @ u[:, : 2 * HIDDEN].T + drh * r
        byte, part = (np.concatenate(c) for c in zip(*into, strict=True))
        order = np.argsort(byte, kind="stable")
        byte, part = byte[order], part[order]
        first = np.flatnonzero(np.diff(byte, prepend=-1))
        g[f"e{d}"][byte[first]] = np.add.reduceat(part, first, axis=0)
    return g


def train(x: np.ndarray, on: np.ndarray, y: np.ndarray, n_langs: int) -> dict:
    rng = np.random.default_rng(SEED)
    p = start(n_langs, rng)
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            use = order[i : i + BATCH]
            g = gradient(p, x[use], on[use], y[use])
            t += 1
            rate = 0.02 / (1 + epoch)
            for k in p:
                d = np.clip(g[k], -1, 1)
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return p


def fit(docs: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE_DOCS) -> tuple[list[str], dict | None]:
    """(languages in order, network), from rows with a lang whose crc32 modulo `folds` is not `held`."""
    rest = fold(F.col("doc_id"), folds)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (rest != held)).select("lang", "text", "doc_id", F.xxhash64("doc_id", "text").alias("h"))
    # one row for each language that the network is to tell apart
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], None
    share = max(1, sample // len(langs))
    # some times the share of a frequent language, by hash, so that no task sees all its rows
    few = docs.sparkSession.createDataFrame([(k, min(1.0, (4 * share + 64) / n)) for k, n in sizes.items()], "lang string, part double")
    known = known.join(F.broadcast(few), "lang").where(F.col("h") / 2.0**64 + 0.5 < F.col("part"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    got = known.withColumn("n", rank).where(F.col("n") <= share).select("lang", "h", "doc_id", "text").collect()  # `sample` rows, or one for each language
    got.sort(key=lambda r: (r["lang"], r["h"], r["doc_id"], r["text"]))
    x, on, text = arrays([r["text"] for r in got])
    use = on.any(1)
    y = np.array([langs.index(r["lang"]) for r in got], np.int64)[text]
    return (langs, train(x[use], on[use], y[use], len(langs))) if use.any() else ([], None)


def _groups(texts: list[str], size: int = WINDOW * TOGETHER):
    """Ranges of texts of about `size` characters in all; a longer one comes alone."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield at, i
            at, held = i, 0
        held += len(t) + WINDOW // 2
    if at < len(texts):
        yield at, len(texts)


def document_sums(p: dict, texts: list[str], n_langs: int) -> np.ndarray:
    """Summed probabilities of each text, and in the last column its labelled positions."""
    out = np.zeros((len(texts), n_langs + 1))
    for i, j in _groups(texts):
        x, on, text = arrays(texts[i:j])
        for k in range(0, len(x), TOGETHER):
            part = slice(k, k + TOGETHER)
            sums = pooled(p, x[part], on[part]).astype(np.float64)
            np.add.at(out[i:j], text[part], np.concatenate([sums, on[part].sum(1, keepdims=True)], 1))
    return out


def identify(docs: DataFrame, folds: int = 5, held: int = 0, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of every row of `docs` with `lang_pred` and its `score`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, folds, held))  # a fixed number of values and some for each language
    fields = [f for f in docs.schema.fields if f.name in columns]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"])

    text = "text" if "text" in columns else "__text"

    def run(batches):
        langs, p = shared.value
        for b in batches:
            sums = document_sums(p, [t or "" for t in b.column(text).to_pylist()], len(langs)) if langs else np.zeros((b.num_rows, 1))
            some = sums[:, -1] > 0
            k = sums[:, :-1].argmax(1) if langs else np.zeros(len(sums), int)
            score = np.where(some, np.minimum(sums[np.arange(len(sums)), k] / np.maximum(sums[:, -1], 1), 1.0), 0.0)
            pred = [langs[i] if yes else UND for i, yes in zip(k.tolist(), some.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*(f.name for f in fields), "lang_pred", "score"])

    return docs.select(*(f.name for f in fields), *([] if text == "text" else [F.col("text").alias(text)])).mapInArrow(run, schema)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
