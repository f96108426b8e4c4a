"""Scores of the language model against counts in plain Python."""

import math
import random
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from scriptorium.llm import lm


def batch(rows):
    blk, text, learn = zip(*rows, strict=True)
    n = len(rows)
    return pa.RecordBatch.from_pydict({"blk": pa.array(blk, pa.int64()), "doc_id": pa.array(range(n), pa.int64()), "text": pa.array(text, pa.string()), "held_out": pa.array([not x for x in learn]), "learn": pa.array(learn)})


def cut(words):
    """The phrases of a text, as tuples of words."""
    out, held = [], []
    for w in words:
        held.append(w)
        if not w or zlib.crc32(w) % lm.PHRASE == 0:
            out.append(tuple(held))
            held = []
    return out


def test_scores_by_plain_counts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))) for _ in range(40)] + [None, "", " \t "]
    texts += [texts[3], texts[3], (texts[4] or "") + " once onlyhere", texts[5].upper()]
    rows = [(i // 20, t, i % 10 != 0) for i, t in enumerate(texts)]
    tables = np.random.default_rng(0).integers(0, 50, (lm.K, lm.SLOTS * 2)).astype(np.uint32)
    model = (lm.frozen(tables), lm.left_out(tables), np.full((lm.GATES, lm.K), 0.3, np.float32), np.full(lm.APM_CTX * lm.APM_BINS, 0.5, np.float32))
    # what Spark adds up by word
    found = [r for b in lm._block_words([batch(rows)]) for r in b.to_pylist()]
    c = Counter()
    for r in found:
        c[r["word"]] += r["n"]
    totals = []
    for phrase in (False, True):
        some = [n for w, n in c.items() if n and w.startswith(b" ") == phrase]
        totals.append((sum(some), len(some), some.count(1), some.count(2)))
    batches = []
    for blk in sorted({r[0] for r in rows}):
        for kind in (0, 1):
            mine = [r["word"] for r in found if r["blk"] == blk and r["word"].startswith(b" ") == bool(kind)]
            n = len(mine)
            batches.append(pa.RecordBatch.from_pydict({"blk": pa.array([blk] * n, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "word": pa.array(mine, pa.binary()), "c": pa.array([c[w] for w in mine], pa.int64())}))
        b = batch([r for r in rows if r[0] == blk])
        batches.append(b.append_column("kind", pa.array([2] * b.num_rows, pa.int32())))
    got = [r for b in lm._scored(types.SimpleNamespace(value=model), "k", totals)(batches) for r in b.to_pylist()]

    docs = [lm.words_of(t) + [b""] for t in texts]
    words, phrases = Counter(), Counter()
    for (_, _, learn), ws in zip(rows, docs, strict=True):
        if learn:
            words.update(ws)
            phrases.update(cut(ws))
    assert totals[0][:2] == (words.total(), len(words)) and totals[1][:2] == (phrases.total(), len(phrases))
    costs = {}

    def mixed(n, cost, table):
        total, kinds = table.total(), len(table)
        n1, n2 = (sum(v == k for v in table.values()) for k in (1, 2))
        less = max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05)
        return -math.log2(max(n - less, 0) / total + less * kinds / total * 2**-cost)

    for r, (_, _, learn), ws in zip(got, rows, docs, strict=True):
        own, own_phrases, bits = Counter(ws) if learn else Counter(), Counter(cut(ws)) if learn else Counter(), 0.0
        for p in cut(ws):
            cost = 0.0
            for w in p:
                without = learn and words[w] == own[w]
                if (w, without) not in costs:
                    costs[w, without] = float(lm.word_bits([w], model, without)[0])
                cost += mixed(words[w] - own[w], costs[w, without], words)
            bits += mixed(phrases[p] - own_phrases[p], cost, phrases)
        assert r["n_tokens"] == len(ws) and r["n_known"] == sum(words[w] > 0 for w in ws) and r["train_tokens"] == words.total()
        assert math.isclose(r["score"], -bits * math.log10(2), rel_tol=1e-6)
        assert math.isclose(r["base_score"], sum(math.log10((words[w] + 0.1) / (words.total() + 0.1 * (len(words) + 1))) for w in ws), rel_tol=1e-9)


def test_blocks_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 100)
    b = batch([(0, t, True) for t in ("x" * 40, None, "y" * 40, "z" * 400, "", "w")]).rename_columns(["part", "doc_id", "text", "held_out", "learn"])
    assert next(lm._numbered([b])).column("blk").to_pylist() == [0, 0, 0, 1, 2, 2]


def running(text):
    """(decisions before, byte) of every byte of a text, read plainly, with its tables' slots."""
    stream = lm.START + b" "
    for w in [*lm.words_of(text), None]:
        coded = b"\n" if w is None else w + b" "
        for i in range(len(coded)):
            yield (stream + coded[:i])[-4:], coded[:i], coded[i]
        stream += coded


def plain_slots(before, so_far, byte):
    """(node, bit, slots) of a byte's decisions, one at a time in Python's integers."""

    def step(h, b):
        h = (h ^ (b + 1)) * 0x9E3779B1 % 2**32
        return h ^ h >> 15

    h, ctx = 0x51ED270B, []
    for b in before[::-1]:
        h = step(h, b)
        ctx.append(h * 0x85EBCA77 % 2**32)
    h = 0xA5A5A5A5
    for b in so_far:
        h = step(h, b)
    ctx.append(h)
    for at in range(lm.OFF[byte], lm.OFF[byte] + lm.LENGTH[byte]):
        slots = []
        for c in ctx:
            x = (c ^ int(lm._NODE_MIX[lm.NODE[at]])) * 0xC2B2AE3D % 2**32
            slots.append((x ^ x >> 14) % lm.SLOTS)
        yield int(lm.NODE[at]), int(lm.BIT[at]), slots


TEXTS = ["the cat of a the cat", "", None, "a é a é \u00e9\u00e9\u00e9\u00e9 b", "Of x\x00y\n\x00 \x00\x00\x00\x00\x00 the cat", "the cat of a the cat sat catalogue"]


def test_every_decision_of_running_text_is_counted_across_words():
    rows = [(0, t, i != 3) for i, t in enumerate(TEXTS)]
    found = [r for b in lm._block_words([batch(rows)], True) for r in b.to_pylist() if r["word"][:1] != b" " and r["n"]]
    table = pa.RecordBatch.from_pydict({"word": pa.array([r["word"] for r in found], pa.binary()), "c": pa.array([r["n"] for r in found], pa.int64())})
    got = np.zeros(lm.K * lm.SLOTS * 2, np.int64)
    for b in lm._count([table]):
        for k, body in zip(b.column("chunk").to_pylist(), b.column("body").to_pylist(), strict=True):
            got[k * 65536 : k * 65536 + len(body) // 8] = np.frombuffer(body, "<i8")
    want = Counter()
    for i, t in enumerate(TEXTS):
        for place in running(t) if i != 3 else ():
            for _, bit, slots in plain_slots(*place):
                want.update(k * lm.SLOTS * 2 + s * 2 + bit for k, s in enumerate(slots))
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(want)


def test_score_reads_the_words_before(monkeypatch):
    monkeypatch.setattr(lm, "SHARES", (1.0,))  # the mixed bits alone
    tables = np.random.default_rng(1).integers(0, 9, (lm.K, lm.SLOTS * 2)).astype(np.uint32)
    model = (lm.frozen(tables), lm.left_out(tables), np.full((lm.GATES, lm.K), 0.3, np.float32), np.full(lm.APM_CTX * lm.APM_BINS, 0.5, np.float32))
    words = list(dict.fromkeys(w for t in TEXTS for w in [*lm.words_of(t), b""]))
    texts = [(t or "").encode() for t in TEXTS]
    more = [b"the cat sat of a", b"of a the cat sat"]
    tokens, _ = lm.tokens_of(texts + more)
    vocabulary = lm.Vocabulary()
    vocabulary.add(words)
    phrases = np.unique(vocabulary.phrases(vocabulary.ids(tokens))[1][0])
    block = lm._Block(words, np.full(len(words), 3), phrases, np.zeros(len(phrases)), "before", model, [(30, 5, 1, 1), (0, 0, 0, 0)], True)
    got = block.score(texts, np.zeros(len(texts), bool))[3]
    for t, bits in zip(TEXTS, got, strict=True):
        want = 0.0
        for place in running(t):
            for _, bit, slots in plain_slots(*place):
                n = [tables[k].reshape(-1, 2)[s].astype(np.float32) for k, s in enumerate(slots)]
                x = float(np.clip(sum(0.3 * float(lm._odds(*(v[None] for v in p))[0]) for p in n), -12, 12))
                p = 1 / (1 + math.exp(-x if bit else x))
                want -= math.log2(0.5 * p + 0.25)
        assert math.isclose(bits, want, rel_tol=1e-4)
    one, other = block.score(more, np.zeros(2, bool))[3]
    assert abs(one - other) > 1e-3  # the same words in another order


def test_shares_are_weighed_over_the_text():
    tokens, parts = np.array([3.0, 9.0]), np.array([5.0, 2.0])
    got = lm.shared_bits(tokens, parts, 0.25)
    assert np.allclose(got, -np.log2(0.75 * 2.0**-tokens + 0.25 * 2.0**-parts))
    assert lm.shared_bits(tokens, parts, 0.0) is tokens and lm.shared_bits(tokens, parts, 1.0) is parts


def test_remembered_heads_change_nothing(monkeypatch):
    tables = np.random.default_rng(2).integers(0, 9, (lm.K, lm.SLOTS * 2)).astype(np.uint32)
    model = (lm.frozen(tables), lm.left_out(tables), np.full((lm.GATES, lm.K), 0.3, np.float32), np.full(lm.APM_CTX * lm.APM_BINS, 0.5, np.float32))
    words, size = lm.tokens_of([(t or "").encode() for t in TEXTS])
    keys = lm.heads_of(words, size)
    assert lm.numbered_heads(lm.named_heads(keys)).tolist() == keys.tolist()
    own = np.arange(len(keys)) % 3
    own[-1] = 1 << 20
    want = [lm.part_bits(keys[i : i + 1], model, own[i : i + 1])[0] for i in range(len(keys))]
    for kept in (1 << 19, 4):
        monkeypatch.setattr(lm, "HEADS_KEPT", kept)
        for _ in range(3):
            assert np.allclose(lm.begun_bits(keys, own, f"kept {kept}", model), want, rtol=1e-9)
            assert np.allclose(lm.begun_bits(keys[::-2], own[::-2], f"kept {kept}", model), want[::-2], rtol=1e-9)


def test_one_occurrence_is_left_out_by_lookup(monkeypatch):
    rng = np.random.default_rng(3)
    tables = rng.integers(0, 4, (lm.K, lm.SLOTS * 2)).astype(np.uint32)
    left = lm.left_out(tables)
    model = (lm.frozen(tables), left, np.full((lm.GATES, lm.K), 0.3, np.float32), rng.random(lm.APM_CTX * lm.APM_BINS).astype(np.float32))
    words = [b"the", b"cataloguing", b"", b"\xc3\xa9\xc3\xa9\xc3\xa9\xc3\xa9", b"elephants"]
    _, _, bit, slots = lm.decisions(words)
    want = lm.evidence(left, slots, bit, np.ones(len(bit), np.int64))
    bits = [[lm.part_bits([w], model, np.array([n]))[0] for w in words] for n in range(3)]
    assert all(np.array_equal(lm.part_bits(words, model, np.full(5, n)), bits[n]) for n in range(3))
    assert np.array_equal(lm.part_bits(words, model, np.array([0, 1, 2, 1, 0])), [bits[0][0], bits[1][1], bits[2][2], bits[1][3], bits[0][4]])
    assert len({x[1] for x in bits}) == 3 and np.array_equal(lm.part_bits(words, model), bits[0])
    monkeypatch.setattr(lm, "_odds", None)  # no logarithms for each decision
    got = lm.evidence(left, slots, bit)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert np.array_equal(lm.part_bits(words, model, np.ones(5, np.int64)), bits[1])


def test_tokens_and_heads_of_whole_texts_at_once():
    texts = [(t or "").encode() for t in [*TEXTS, "\x0b\x0cA \x1c\x85\u00a0 b\r\n\tC", " ", "x", ""]]
    words, size = lm.tokens_of(texts)
    want = [[*lm.words_of(t), b""] for t in texts]
    assert words.to_pylist() == [w for ws in want for w in ws] and size.tolist() == list(map(len, want))
    vocabulary = lm.Vocabulary()
    ids = vocabulary.add(words.slice(3)).tolist()
    plain = list(dict.fromkeys(words.to_pylist()[3:]))
    assert list(vocabulary.at) == plain and ids == [plain.index(w) for w in words.to_pylist()[3:]]
    assert vocabulary.ids(words.to_pylist()[3:]).tolist() == ids
    heads = []
    for ws in want:
        before = lm.START
        for w in ws:
            heads.append(b"\t" + before[-lm.HEAD :] + (w + b" " if w else b"\n")[: lm.HEAD].ljust(lm.HEAD, b"\n"))
            before += b" " + w
    assert lm.named_heads(lm.heads_of(words, size)).to_pylist() == heads
