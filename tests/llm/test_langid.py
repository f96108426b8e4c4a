"""Language identification: pooling by brute force, letters, sampling and odd tables."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import langid


def plain(p, text):
    """Mean probabilities over the letters of a text, one byte after another in Python floats."""
    text = text.lower()
    raw, labelled = list(text.encode()), []
    for c in text:
        labelled += [langid.unicodedata.category(c).startswith("L")] * len(c.encode())
    sign = lambda v: v / (1 + abs(v))
    total, n = [0.0] * len(p["out_b"]), 0
    H = langid.HIDDEN
    for at in range(0, len(raw), langid.WINDOW):
        window = raw[at : at + langid.WINDOW]
        states = {}
        for d, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            h = [0.0] * H
            for t in order:
                e, u = p["e" + d][window[t]].tolist(), p["u" + d].tolist()
                gate = [(1 + sign(e[j] + sum(h[i] * u[i][j] for i in range(H)))) / 2 for j in range(2 * H)]
                new = [sign(e[2 * H + j] + sum(gate[H + i] * h[i] * u[i][2 * H + j] for i in range(H))) for j in range(H)]
                h = [h[j] + gate[j] * (new[j] - h[j]) for j in range(H)]
                states[d, t] = h
        for t in range(len(window)):
            if labelled[at + t]:
                both = states["f", t] + states["b", t]
                q = [math.exp(sum(both[i] * float(p["out"][i, k]) for i in range(2 * H)) + float(p["out_b"][k])) for k in range(len(total))]
                total = [a + b / sum(q) for a, b in zip(total, q, strict=True)]
                n += 1
    return [*total, n]


def test_pooling_by_brute_force():
    p = langid.start(3, np.random.default_rng(5))
    rng = random.Random(4)
    texts = ["", "12 ½ ² Ⅷ", "Über  die Straße\n", "x", "".join(rng.choice("aé ß𝒳☃Z1.") for _ in range(150))]
    got = langid.document_sums(p, texts, 3)
    for row, t in zip(got, texts, strict=True):
        assert np.allclose(row, plain(p, t), atol=1e-3), t
    assert got[1][-1] == 0


def test_letters_span_all_bytes_of_a_character():
    t = "aß½²Ⅷ中𝒳 ☃"
    assert langid.letters(t).tolist() == [c in "aß中𝒳" for c in t for _ in c.encode()]


def test_every_language_can_be_learned(spark):
    langs = [f"l{k:03d}" for k in range(300)]
    rows = [(i, f"word{i % 300} text", langs[i % 300], i, "x") for i in range(600)] + [(None, None, None, 1, "y"), (3, "½ ² Ⅷ", "l003", 1, "z")] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int, score string")
    few, langid.EPOCHS = langid.EPOCHS, 1
    try:
        assert langid.fit(d)[0] == sorted({r[2] for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 5})
        got = langid.identify(d)
    finally:
        langid.EPOCHS = few
    rows = got.collect()
    assert len(rows) == 604 and sum(r["lang_pred"] == "und" and r["score"] == 0 for r in rows) == 4
    assert langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
