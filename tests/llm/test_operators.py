"""Small tables with nulls, empty texts, ties and repeated rows, and brute-force versions."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, hnsw, langid, lm, mixing, packing, quality, simhash, tokencount, topk

P = pytest.importorskip("public_tokenizers")
WORDS = {"en": "the of and that with thing onion ration".split(), "de": "der und ist nicht über schön keit ung".split()}


def documents(spark, n=120):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        w = [rng.choice(WORDS[lang]) + rng.choice(["", "", rng.choice(WORDS[lang])]) for _ in range(rng.randint(5, 80))]
        if i % 7 == 0:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), lang, f"s{i % 3}", len(w), "x"))
    rows += [(n, None, None, None, None, "x"), (n + 1, "", "en", "s0", 0, "x"), (n + 2, "12 34", "en", "s0", 5, "x"), (n + 3, "word " * 30000, "en", "s1", 1, "x"), (None, "the of", "en", "s1", 1, "x")]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def labels(spark, n=120):
    return spark.createDataFrame([(i, 0 if i % 7 == 0 else 1, 0) for i in range(n)] + [(1, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")


def empty(df):
    return df.where("false")


def test_quality(spark):
    d = documents(spark)
    got = quality.score(d, labels(spark)).collect()
    assert len(got) == d.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 120 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["predicted"] == (r["doc_id"] % 7 != 0) for r in held) >= 0.9 * len(held)
    assert quality.score(empty(d), empty(labels(spark))).count() == 0


def test_lm_counts_and_base(spark):
    d = documents(spark)
    got = {r["doc_id"]: r for r in lm.score(d).collect()}
    rows = [(r["doc_id"], lm.words_of(r["text"]) + [b""]) for r in d.collect()]
    count: dict = {}
    for i, ws in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            for w in ws:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, ws in rows:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in count for w in ws), n)
        assert np.isclose(r["base_score"], sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert np.isfinite(r["score"]) and r["score"] <= 0
    assert lm.score(empty(d)).count() == 0


def test_word_probabilities_do_not_exceed_one():
    rng = np.random.default_rng(0)
    tables = rng.integers(0, 50, (lm.K, lm.SLOTS * 2)).astype(np.uint32)
    model = (lm.frozen(tables), lm.left_out(tables), np.full((lm.GATES, lm.K), 0.3, np.float32), np.full(lm.APM_CTX * lm.APM_BINS, 0.5))
    assert np.exp2(-lm.word_bits([bytes([b]) for b in range(33, 256)] + [b""], model)).sum() <= 1


def test_left_out_tables_take_one_decision_away():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (lm.K, lm.SLOTS, 2))
    less = lm.left_out(counts.reshape(lm.K, -1).astype(np.uint32))
    slots, bit = rng.integers(0, lm.SLOTS, (lm.K, 300)), rng.integers(0, 2, 300)
    st, gate = lm.evidence(less, slots, bit)
    for j in range(300):
        levels = []
        for k in range(lm.K):
            n = counts[k, slots[k, j]].copy()
            n[bit[j]] = max(n[bit[j]] - 1, 0)
            back = 0.02 + 0.4 / (n.sum() + 1.5)
            assert np.isclose(st[k, j], np.log((n[1] + back) / (n[0] + back)) if n.sum() else 0, atol=1e-4)
            levels.append(int(n.sum() > 0) + int(n.sum() > 2) + int(n.sum() > 30))
        assert gate[j] == levels[-2] * lm.LEVELS + levels[-1]


def test_golay_keys_and_bucket_links():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flip = np.uint64(1) << rng.integers(0, 64, (2, 300), dtype=np.uint64)
    b = a ^ flip[0] ^ flip[1]
    for x, y in zip(a, b, strict=True):
        shared = set(simhash.keys(np.array([x]))[1].tolist()) & set(simhash.keys(np.array([y]))[1].tolist())
        assert shared
    counts = np.bincount(simhash.fuzzy_keys(np.arange(4096, dtype=np.uint32))[0])
    assert set(counts.tolist()) == {1, 6}
    for n in (300, 3000):  # blocks of distances, and patterns
        base = np.uint64(0x123456789ABCDEF0) & ~np.uint64(((1 << 22) - 1) << 42)
        free = rng.integers(0, 1 << 12, n, dtype=np.uint64)
        fp = np.unique(base ^ free)
        moved, root = simhash.bucket_links(fp, 0)
        parent = {int(x): int(x) for x in fp}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, x in enumerate(fp):
            for y in fp[i + 1 :][np.bitwise_count(fp[i + 1 :] ^ x) <= 2]:
                ra, rb = find(int(x)), find(int(y))
                parent[max(ra, rb)] = min(ra, rb)
        want = {x: find(x) for x in parent if find(x) != x}
        assert dict(zip(moved.tolist(), root.tolist(), strict=True)) == want


def test_simhash_groups(spark):
    d = documents(spark)
    got = simhash.groups(d).collect()
    assert len(got) == d.count()
    fps = [(r["doc_id"], np.uint64(r["fp"] & (1 << 64) - 1)) for r in got]
    for r in got:
        reach, grown = {np.uint64(r["fp"] & (1 << 64) - 1)}, True
        while grown:
            new = {f for _, f in fps if any(np.bitwise_count(f ^ x) <= 2 for x in reach)}
            grown, reach = len(new) > len(reach), reach | new
        assert r["component_id"] == min((i for i, f in fps if f in reach and i is not None), default=None)
    assert simhash.groups(empty(d)).count() == 0


def test_simhash_names_every_row_of_a_frequent_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARES", 8)
    rows = [(i if i % 3 else None, "one and the same text" if i % 2 else f"another text {i} of {i * i} words") for i in range(400)]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = simhash.fingerprint([t.encode() for _, t in rows]).view(np.int64).tolist()
    assert Counter((r["doc_id"], r["fp"]) for r in got) == Counter(zip((i for i, _ in rows), want, strict=True))
    same = [r for r in got if r["fp"] == want[1]]
    assert len(same) >= 200 and {r["component_id"] for r in same} == {1}


def vectors(spark, n=400):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.12).tolist(), i % 3) for i in range(n)]
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [1.0] * 16, None), (n + 4, [1.0, None] + [0.0] * 14, 1), (n + 5, rows[0][1], 0), (n + 6, [1.0] * 4, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_hnsw_against_all_pairs(spark):
    v = vectors(spark)
    for shard in (8192, 40):
        got = {r["vec_id"]: r for r in hnsw.near_duplicates(v, shard=shard).collect()}
        rows = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in v.collect() if r["embedding"] and None not in r["embedding"] and r["label"] is not None]
        rows = [r for r in rows if np.isfinite(r[1]).all() and r[1].any()]
        cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b) if len(a) == len(b) else 0
        near = {i: {j for j, y, m in rows if j != i and m == label and cos(x, y) >= 0.93} for i, x, label in rows}
        assert {i: r["n_links"] for i, r in got.items()} == {i: len(near.get(i, ())) for i in got}
        for i, r in got.items():
            reach, todo = {i}, [i]
            while todo:
                new = near.get(todo.pop(), set()) - reach
                reach |= new
                todo += new
            assert r["component_id"] == min(reach) and r["kept"] == (min(reach) == i)
    assert hnsw.near_duplicates(empty(v)).count() == 0


def test_topk_against_all_pairs(spark):
    x = topk.scaled(vectors(spark))
    rows = [(r["vec_id"], r["x"]) for r in x.collect()]
    got = sorted(map(tuple, topk.search(x, "vec_id % 50 = 0", 5).collect()))
    want = []
    for i, a in rows:
        if i % 50 == 0:
            s = sorted((-sum(p * q for p, q in zip(a, b, strict=False)), j) for j, b in rows if j != i)[:5]
            want += [(i, k + 1, j, -t) for k, (t, j) in enumerate(s)]
    assert got == sorted(want)
    assert topk.search(empty(x), "vec_id % 50 = 0").count() == 0


def test_mixing_stays_within_a_block(spark):
    d = spark.createDataFrame([(i, f"s{min(i % 10, 4)}") for i in range(5000)] + [(None, None)] * 3, "doc_id long, source string")
    got = mixing.mix(d, {"s0": 0.4, "s1": 0.35, "s4": 0.25}, block=2).collect()
    assert len(got) == 5003
    used = sorted((r["slot"], r["source"]) for r in got if r["slot"] is not None)
    order = list(dict.fromkeys(used))
    assert [t for t, _ in order] == list(range(len(order))) and len({r["position"] for r in got if r["slot"] is not None}) == len(used)
    share = {s: c / mixing.PERIOD for s, c in mixing.slots_of({"s0": 0.4, "s1": 0.35, "s4": 0.25}, mixing.PERIOD).items()}
    seen = dict.fromkeys(share, 0)
    for t, s in order:
        seen[s] += 1
        assert all(abs(seen[k] - share[k] * (t + 1)) < 1 for k in share)
    assert mixing.mix(empty(d)).count() == 0


def test_token_counts_agree_with_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokencount.load_pieces(P.path("piece_bpe_32k.model"))
    for vocabulary in (pieces, [("a", -1.0), ("ab", -2.0), ("b", -1.0), ("▁a", -2.0), ("▁", -1.0), ("aba", -3.0)]):
        t = Tokenizer(models.Unigram([("\x00", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter, rng = tokencount.Counter(vocabulary), random.Random(2)
        for _ in range(500):
            s = "".join(rng.choice("aab b\n☃é▁") for _ in range(rng.randint(0, 25)))
            assert counter.text(s)[0] == len(t.encode(s, add_special_tokens=False).ids), s
    d = documents(spark)
    assert tokencount.count(d, pieces).count() == d.count() and tokencount.count(empty(d), pieces).count() == 0


def cheapest(roles):
    """Least cost by trying every path of states, one turn after another."""
    best = {chat.START: 0}
    for r in roles:
        new = {}
        for a, c in best.items():
            for p, chain in ((p, ch) for (x, p), ch in chat.INSERTED.items() if x == a):
                for x in chat.NEXT[p]:
                    new[x] = min(new.get(x, 99999), c + 2 * len(chain) + (0 if x == r else 3))
                if p != chat.START:
                    new[p] = min(new.get(p, 99999), c + 2 * len(chain) + 1 + (0 if p == r else 3))
        best = new
    return min(c + chat.finish(q)[0] for q, c in best.items())


def test_chat_repair(spark):
    rng = random.Random(6)
    convs = {i: [rng.choice(["user", "assistant", "system", "tool", None]) for _ in range(rng.choice([1, 2, 5, 40]))] for i in range(12)}
    convs[99] = [rng.choice(["user", "assistant"]) for _ in range(1300)]
    d = spark.createDataFrame([(c, t, r, f"{c}.{t}") for c, rs in convs.items() for t, r in enumerate(rs)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {}
    for r in sorted(chat.repair(d).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["position"])):
        got.setdefault(r["conv_id"], []).append(r)
    assert set(got) == {*convs, None}
    for c, rs in got.items():
        state, cost = chat.START, 0
        assert [r["position"] for r in rs] == list(range(len(rs)))
        for r in rs:
            nxt = chat.ROLES.index(r["role"])
            assert nxt in chat.NEXT[state]
            state = nxt
            cost += sum(chat.INSERT * (a == "insert") + chat.RELABEL * ("relabel" in a) + chat.MERGE * ("merge" in a) for a in r["actions"].split(","))
        assert state == chat.ASSISTANT
        if c is not None:
            assert cost == cheapest([chat.ROLES.index(r) if r in chat.ROLES else 0 for r in convs[c]])
            assert "\n".join(r["text"] for r in rs if r["n_turns"]) == "\n".join(f"{c}.{t}" for t in range(len(convs[c])))


def test_packing_is_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i, s) for i, s in enumerate(["", "a b", "a  b\n\nc ", " x\ty", "naïve ☃ don't\n" * 300, "<|endoftext|> z", "\x01", "1 2\n3", "e f"])] + [(3, " x\ty"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(d, P.path("byte_bpe_50k.json")).collect()
    want = sorted((np.array([*t.encode(s or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, s in rows))
    docs: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        docs.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append(r)
    ids = []
    for rs in docs.values():
        for r in sorted(rs, key=lambda r: r["start"]):
            ids.append(bytes(r["ids"]))
    assert sum(map(len, ids)) == sum(map(len, want))
    whole = {w for w in want if len(w) // 4 < 1024}
    assert all(w in {b"".join(bytes(r["ids"]) for r in sorted(rs, key=lambda r: r["start"])) for rs in docs.values()} | set(ids) for w in whole)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert packing.pack(empty(d), P.path("byte_bpe_50k.json")).count() == 0


def test_hilbert_curve_visits_neighbours():
    pts = np.array([[x, y] for x in range(16) for y in range(16)])
    order = pts[np.argsort(packing.hilbert(pts, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_language_and_gradient(spark):
    d = documents(spark)
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (120, 121, 122))
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in held) >= 0.9 * len(held)
    assert langid.identify(empty(d)).count() == 0
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.start(2, rng).items()}
    x, on, _ = langid.arrays(["abc d", "De", "é1 x"])
    assert on.sum(1).tolist() == [4, 2, 3]
    y = np.array([0, 1, 0])

    def softmax(p):
        f, b = (langid.run_direction(p, d, x, False)[0] for d in "fb")
        q = np.exp(np.concatenate([f, b], 2) @ p["out"] + p["out_b"])
        return q / q.sum(2, keepdims=True)

    def loss(p):
        q = softmax(p)
        return -(np.log(q[np.arange(3)[:, None], np.arange(x.shape[1])[None], y[:, None]]) * on).sum() / on.sum()

    single = {k: v.astype(np.float32) for k, v in p.items()}
    assert np.allclose(langid.pooled(single, x, on), (softmax(single) * on[:, :, None]).sum(1), atol=1e-4)
    g = langid.gradient(p, x, on, y)
    for k in ("ef", "ub", "out"):
        at = (97, 3) if k == "ef" else (2, 1)
        hi, lo = {**p, k: p[k].copy()}, {**p, k: p[k].copy()}
        hi[k][at] += 1e-3
        lo[k][at] -= 1e-3
        assert abs((loss(hi) - loss(lo)) / 2e-3 - g[k][at]) < 1e-3
