"""Cases in which an operator once did less than the whole job."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import mixing, tokencount


def scheduled(rows):
    """Rows in the order of their positions, which must all be given and differ."""
    assert all(r["position"] is not None for r in rows) and len({r["position"] for r in rows}) == len(rows)
    return sorted(rows, key=lambda r: r["position"])


def test_mixing_schedules_every_row_beside_a_tiny_source(spark):
    d = spark.createDataFrame([(i, f"s{i % 20}") for i in range(20000)] + [(None, None), (20001, "tiny")], "doc_id long, source string")
    got = scheduled(mixing.mix(d).collect())
    assert len(got) == 20002
    for n in range(1000, 20000, 1000):
        seen = [r["source"] for r in got[:n]]
        assert all(abs(seen.count(f"s{k}") - n / 20) < 2 * mixing.BLOCK for k in range(20))
    # a target that one source cannot fill, or that leaves sources out, comes first and the rest after it
    rows = mixing.mix(d, {"s0": 0.5, "s1": 0.4999, "tiny": 0.0001, "none": 0.5}).collect()
    got = scheduled(rows)
    first = [r for r in got if r["slot"] is not None]
    assert len(got) == 20002 and got[: len(first)] == first and {r["source"] for r in first} <= {"s0", "s1", "tiny"} and len(first) > 1000


def test_pipeline_mixing_keeps_every_document_once(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}" if i % 10 else None, 2) for i in range(300)] + [(None, "a", "en", "x", 1), (None, "a", "en", "x", 1), (7, "other", "en", "x", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumn("extra", F.lit(1))
    got = [tuple(r) for r in corpus_pipeline.source_mix(spark, d, "").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(rows, key=key)


def test_mixing_by_own_shares_has_no_cap(spark):
    d = spark.createDataFrame([(i, "hot" if i % 10 else f"s{i % 3}") for i in range(6000)], "doc_id long, source string")
    sizes = {r["source"]: r["count"] for r in d.groupBy("source").count().collect()}
    got = scheduled(mixing.mix(d).collect())
    assert [r["position"] for r in got] == list(range(6000)) and all(r["slot"] < r["deadline"] for r in got)
    seen, turns = dict.fromkeys(sizes, 0), list(dict.fromkeys((r["slot"], r["source"]) for r in got))
    for t, (slot, source) in enumerate(turns):
        seen[source] += 1
        assert slot == t and all(abs(seen[s] - -(-n // mixing.BLOCK) * (t + 1) / len(turns)) < 1 for s, n in sizes.items())
    assert mixing.whole({"a": 10**9, "b": 1}, mixing.BLOCK)[1][-1][3] < 10**9 + 1


def test_mixing_has_one_size_of_blocks_whatever_the_table(spark):
    block, runs = mixing.whole({"a": 6_000_000, "b": 2_000_000}, mixing.BLOCK)
    assert block == mixing.BLOCK and sum(r[-1] for r in runs) == 1_000_000
    d = spark.range(300_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source")
    rows = {r["position"]: r["source"] for r in mixing.mix(d).collect()}
    assert sorted(rows) == list(range(300_000))
    got = "".join(rows[i] for i in range(300_000))
    assert all(abs(got.count("a", 0, n) - n / 3) < mixing.BLOCK for n in range(0, 300_000, 1117)) and "a" * 17 not in got


def test_runs_are_the_earliest_deadlines_slot_by_slot():
    rng = random.Random(8)
    for _ in range(200):
        slots = {f"s{i}": rng.choice((1, 2, 5, 40, 300)) for i in range(rng.randint(1, 6))}
        period = sum(slots.values())
        done, want = dict.fromkeys(slots, 0), []
        for t in range(period):
            ready = [(-(-(k + 1) * period // slots[s]), s) for s, k in done.items() if k < slots[s] and k * period // slots[s] <= t]
            want.append((min(ready)[1], done[min(ready)[1]], t))
            done[min(ready)[1]] += 1
        assert mixing.period_of(slots, period) == want


def test_near_duplicates_keeps_one_row_of_each_group(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40))
    null, same, pair = [text() for _ in range(20)], [text(), text()], text()
    rows = [(None, t) for t in null] + [(None, null[0])] * 3 + [(1, t) for t in same] + [(3, pair), (2, pair), (None, pair), (2, pair), (None, ""), (None, None)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, d, "").collect()]
    assert sorted(got, key=str) == sorted([(None, t) for t in null] + [(1, t) for t in same] + [(2, pair), (None, "")], key=str)


def test_token_counts_have_byte_pieces_and_runs_of_marks():
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    pieces = tokencount.load_pieces(path)
    assert tokencount.has_byte_pieces(path)
    counter, rng = tokencount.Counter(pieces, byte_pieces=True), random.Random(8)
    t = Tokenizer(models.Unigram([("\x00", 0.0), *pieces, *((f"<0x{b:02X}>", 0.0) for b in range(256))], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    assert counter.text("\u9b31" * 4)[0] == 13 and counter.text("x\n\n\n\ny")[0] == 6 and counter.text("a" + " " * 8 + "b")[0] == 3
    for _ in range(500):
        s = "".join(rng.choice(["a", "the", " ", "   ", "\n", "\u9b31", "☃", "é", "▁"]) for _ in range(rng.randint(0, 25)))
        assert counter.text(s)[0] == len(t.encode(s, add_special_tokens=False).ids), s
