"""Every stage of the pipeline on rows without an id, with one id, with odd values; the queries' columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import mixing, packing, registry
from scriptorium.llm.common import materialise

P = pytest.importorskip("public_tokenizers")
EN, DE = "the of and that with thing onion ration because under".split(), "der und ist nicht über schön keit ung weil unter".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with clean and bad documents in two languages, and rows that share an id."""
    rng, at = random.Random(9), str(tmp_path_factory.mktemp("sf"))
    rows = []
    for i in range(160):
        words = [rng.choice(DE if i % 2 else EN) + rng.choice(["", rng.choice(DE if i % 2 else EN)]) for _ in range(rng.randint(40, 90))]
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if i % 5 == 0 else " ".join(words), "de" if i % 2 else "en", f"s{i % 3}", 1))
    clean = [r for r in rows if r[0] % 5]
    other = lambda: " ".join(rng.choice(EN) + rng.choice(EN) for _ in range(60))
    rows += [(None, other(), "en", "s0", 1), (None, other(), "en", "s1", 1), (7, other(), "en", None, 1)]
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), clean[4], clean[4]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.withColumn("score", F.lit("x")).withColumn("position", F.lit(1)).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", F.coalesce("text", F.lit("")), "source").collect()), key=str)


def test_stages_keep_rows_apart(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, folder)
        assert kept.columns == list(corpus_pipeline.COLUMNS), name
        rows, old = as_rows(kept), as_rows(before)
        assert all(r in old for r in rows), name
        assert sum(r[0] is None for r in rows) == 2 and sum(r[0] == 7 for r in rows) == 2, name
        if name == "simhash near-dedup":
            assert len(rows) == len({r[1] for r in rows})
        elif name == "source mixing":
            assert rows == old
    assert {r[0] for r in rows} >= {i for i in range(160) if i % 5} and not any(r[0] is not None and r[0] < 160 and r[0] % 5 == 0 for r in rows)


def test_run_packs_what_the_stages_kept(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert sum(r["start"] == 0 for r in got) == 128 + 3
    sequences = {}
    for r in got:
        sequences[r["sequence_id"]] = sequences.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in sequences.values())


def test_packing_goes_by_the_order_of_the_mix(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "WINDOW", 20)
    rng = random.Random(3)
    # unlike texts, which the curve sets apart, and files of unlike sizes, which a reader takes out of order
    rows = [(i, " ".join(rng.choice(DE if i % 3 else EN) for _ in range(rng.randint(100, 300))), "x", "de" if i % 3 else "en", 1) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = materialise(corpus_pipeline.source_mix(spark, d, "").coalesce(3))
    order = {r[0]: i for i, r in enumerate(sorted(mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect(), key=lambda r: (r[1], r[2])))}
    position = {r["doc_id"]: r["position"] for r in mixing.mix(d).collect()}
    assert all(position[a] < position[b] for a, b in zip(list(order)[:-1], list(order)[1:], strict=True))
    for docs in (mixed, mixed.select("*")):  # from files, and from a plan
        got = sorted(corpus_pipeline.packed(spark, docs, "").collect(), key=lambda r: (r["sequence_id"], r["offset"]))
        assert {r["doc_id"] for r in got} == set(order)
        for n in range(100, len(got), 100):
            share = sum(r["doc_id"] % 3 == 0 for r in got[:n]) / n
            assert abs(share - 1 / 3) < 0.12
        if docs is mixed:
            firsts = [order[r["doc_id"]] for r in got if r["start"] == 0]
            ends = sorted(firsts)
            assert all(abs(a - b) <= 40 for a, b in zip(firsts, ends, strict=True))


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_small_sources_are_scheduled_together_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 5)
    d = spark.createDataFrame([(i if i % 7 else None, f"s{i % 20}" if i > 100 else "hot") for i in range(400)], "doc_id long, source string")
    got = mixing.mix(d).collect()
    assert sorted(r["position"] for r in got) == list(range(400)) and sorted((str(r["doc_id"]), r["source"]) for r in got) == sorted((str(r["doc_id"]), r["source"]) for r in d.collect())


COLUMNS = {
    "op1_quality": "doc_id held_out score predicted", "op4_simhash": "doc_id fingerprint component_id", "op5_mixing": "doc_id source place block slot deadline position",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op10_langid": "doc_id held_out lang_pred score",
}


def test_queries_have_their_columns(spark, folder):
    import zlib

    for name, columns in COLUMNS.items():
        df = registry.QUERIES[name](spark, folder)
        assert df.columns == columns.split(), name
        rows = df.collect()
        for r in rows:
            if "held_out" in df.columns and r["doc_id"] is not None:
                assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % (3 if name == "op1_quality" else 5) == (1 if name == "op1_quality" else 0))
            if name == "op4_simhash":
                assert len(r["fingerprint"]) == 16 and set(r["fingerprint"]) <= set("0123456789abcdef")
    pieces = {(r["doc_id"], r["start"], r["length"]): r["ids"] for r in packing.pack(spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 5"), P.path("byte_bpe_50k.json")).collect()}
    assert all(len(ids) == 4 * n for (_, _, n), ids in pieces.items())
