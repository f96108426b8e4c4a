"""Rows without an id or with one id, detection, sinks, sources, the command line, streams and SQL functions."""

import io
import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import scriptorium
from scriptorium import cli
from scriptorium.functions import kernel as K
from scriptorium.functions import text as T
from scriptorium.functions.keytables import BY_ID, ENCODINGS
from scriptorium.operators import detect, fonts, sinks
from scriptorium.operators.decode import REFUSED, decode_text, decode_tokens
from scriptorium.sources import layout
from scriptorium.streaming import decode as stream

LEGACY = "kai; ejn toi'\" fivloi\" oiJ yuchvn ejxei'pen"
READ = "καὶ ἐν τοῖς φίλοις οἱ ψυχήν ἐξεῖπεν"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, table_id string, score int")


def test_rows_of_one_id_stay_apart(spark):
    d = texts(spark, [(1, LEGACY), (1, "plain words of no such kind at all"), (None, LEGACY + " kai;"), (None, None), (2, "")])
    got = sorted(((r.doc_id, r.text, r.table_id, r.refusal is not None) for r in decode_text(d).collect()), key=str)
    want = [(1, READ, "graeca", False), (1, None, None, True), (None, READ + " καὶ", "graeca", False), (None, None, None, True), (2, None, None, True)]
    assert got == sorted(want, key=str)
    assert decode_text(d).where("refusal is not null").first().refusal == REFUSED
    s = detect.scores(d).collect()
    assert len(s) == 5 * 8 and all(0 <= r.score <= 1 for r in s) and sorted(r.rank for r in s) == sorted(list(range(1, 9)) * 5)
    assert decode_text(d.where("false")).count() == 0
    with pytest.raises(KeyError):
        decode_text(d, "nosuch")


def test_tokens_as_expressions_and_as_columns_agree(spark):
    samples = [LEGACY, "a-b -x- --- 12 é§«kai;» [fol. 3] 𝟎x𝟏 Å.b c d", "", "Øç ˆIjsoÕ pi,stij, qeou/. 'me\";n'"]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    for e in ENCODINGS:
        want = {r.i: r.t for r in d.select("i", T.tokens(F.col("s"), e.table_id).alias("t")).collect()}
        for i, s in enumerate(samples):
            assert K.tokenize(K.CHUNKS.findall(s), K.TABLE[e.table_id])[1] == want[i], (e.table_id, s)


def by_hand(table_id, text):
    """Score of a text, token after token."""
    e, t = BY_ID[table_id], K.TABLE[table_id]
    tokens = K.tokenize(K.CHUNKS.findall(text[: detect.SAMPLE_CHARS]), t)[1]
    used = tokens[: detect.SAMPLE_TOKENS]
    out = [K.decode([w], np.array([t]))[0] for w in used]
    greek, length = sum(len(K.GREEK.findall(o[0])) for o in out), sum(len(o[0]) for o in out)
    coded = sum(any(c in e.marks for c in w) for w in used) / max(1, len(tokens))
    return sum(len(w) - len(o[1]) for w, o in zip(used, out, strict=True)) / max(1, sum(map(len, tokens))) * (greek / length if length else 0) * min(1, coded / 0.3)


def test_scores_by_hand():
    samples = [LEGACY, "a" * 5000, "kai;*ejn%toi'&b " * 300, "x́ ý Øͅ ;' " * 40]
    got = detect.rates([s[: detect.SAMPLE_CHARS] for s in samples])
    for i, s in enumerate(samples):
        for k, name in enumerate(detect.NAMES):
            assert abs(got[i, k, 0] - by_hand(name, s)) < 1e-12, (s[:20], name)


def glyphs(line, text, font):
    return [{"type": "char", "text": c, "font": font, "size": 10, "x0": 50 + 5 * k, "x1": 55 + 5 * k, "y0": 600 - 12 * line, "y1": 610 - 12 * line, "skew": 0} for k, c in enumerate(text)]


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "pages.jsonl")
    a = {"type": "line", "objs": [*glyphs(0, "see kaiØ", "Garamond")[:4], *glyphs(0, "    pare/lqh|", "XXXXXX+SPIonic")[4:], {"type": "anno", "text": " "}]}
    b = {"type": "line", "objs": glyphs(1, "kaiØ; ejn", "ABCDEF+Graeca")}
    inner = {"type": "figure", "objs": [{"type": "figure", "objs": [{"type": "box", "objs": [{"type": "line", "objs": glyphs(2, "within", "Garamond")}]}]}]}
    pages = [
        {"doc_id": 0, "page_no": 3, "width": 500, "height": 700, "objs": [{"type": "box", "objs": [a, b]}, inner]},
        {"doc_id": 0, "page_no": 4, "width": 500, "height": 700, "objs": []},
    ]
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(p) for p in pages))
    return path


def test_layout_trees(spark, trees):
    g, sizes = layout.read(spark, trees)
    assert sizes.count() == 2 and g.where("kind = 'anno'").count() == 1
    lines = lambda g: sorted("".join(r.t) for r in g.groupBy("box_no", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("glyph_no", "text"))), lambda x: x["text"]).alias("t")).collect())
    assert lines(g) == ["kaiØ; ejn", "see pare/lqh| ", "within"]
    flat = layout.read(spark, trees, recursive=False)[0]
    assert lines(flat) == ["kaiØ; ejn", "see pare/lqh|"]
    runs = fonts.runs(layout.run_glyphs(flat))
    assert sorted((r.font, r.text) for r in runs.collect()) == [("Garamond", "see "), ("Graeca", "kaiØ; ejn"), ("SPIonic", "pare/lqh|")]
    assert [(r.font, r.n_chars) for r in fonts.fonts_by_count(fonts.census(runs)).collect()] == [("Graeca", 9), ("SPIonic", 9)]
    toks = sinks.decode_pages(runs)
    assert [(r.family_no, r.table_id) for r in toks.orderBy("family_no", "tok_no").collect()] == [(0, "spionic-cid"), (1, "graeca"), (1, "graeca")]
    out = json.loads(sinks.page_tokens_json(toks).first().json)
    assert out["page"] == 3 and [t["font"] for t in out["tokens"]] == ["SPIonic", "Graeca", "Graeca"] and [t["fully_mapped"] for t in out["tokens"]][1:] == [False, True]
    assert sinks.page_text(toks).first().text.startswith("--- page 3\n") and sinks.page_text(toks).first().text.endswith(" ἐν")
    w = {r.page_no: r for r in sinks.token_warnings(toks).collect()}
    assert w[3].n >= 1 and "kaiØ;" in w[3].first
    has = scriptorium.has_legacy_greek(g).collect()
    assert [(r.page_no, r.has_legacy_greek) for r in has] == [(3, True)]


def run(spark, capsys, *args):
    code = cli.run(list(args), spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_command_line(spark, capsys, trees, monkeypatch):
    assert run(spark, capsys, "--text", LEGACY) == (0, READ + "\n", "[encoding: graeca, auto-detected]\n")
    code, out, _ = run(spark, capsys, "--text", LEGACY, "--json")
    got = json.loads(out)
    assert code == 0 and got["text"] == READ and got["encoding"] == "graeca" and len(got["detection"]) == 5 and got["detection"][0]["table_id"] == "graeca"
    assert run(spark, capsys, "--text", "plain words of no such kind")[0] == 2 and run(spark, capsys, "--text", "x", "--encoding", "nosuch")[0] == 2
    code, out, err = run(spark, capsys, "--text", "qeoØ\" hello there", "--encoding", "graeca")
    assert code == 0 and "Ø" in out and "1 unmapped code(s)" in err
    monkeypatch.setattr(sys, "stdin", io.StringIO(LEGACY))
    assert run(spark, capsys, "--stdin", "--encoding", "graeca")[1] == READ + "\n"
    assert len(run(spark, capsys, "--list-encodings")[1].splitlines()) == 9
    assert run(spark, capsys, trees, "--list-fonts")[1] == "Graeca\t9 chars\nSPIonic\t9 chars\n"
    code, out, err = run(spark, capsys, trees)
    assert code == 0 and out.startswith("--- page 3\n") and "contain unmapped codes" in err
    assert run(spark, capsys, trees, "--page", "9")[0] == 1
    code, out, err = run(spark, capsys, trees, "--layers")
    assert code == 0 and [json.loads(x)["page"] for x in out.splitlines()] == [3, 4]
    code, out, err = run(spark, capsys, trees, "--md")
    assert code == 0 and out.startswith("## PDF page 3") and "page 4: no extractable" in err
    assert run(spark, capsys, "nosuch.pdf")[0] == 2
    with pytest.raises(SystemExit):
        cli.main([], spark)


def test_stream(spark, tmp_path):
    texts(spark, [(1, LEGACY), (2, None)]).select("doc_id", "text").write.parquet(f"{tmp_path}/in")
    rows = []
    s = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    stream.start(s, "graeca", lambda df, n: rows.extend(df.collect()), f"{tmp_path}/check").awaitTermination(120)
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, READ), (2, "")]


def test_sql_functions(spark):
    scriptorium.register(spark)
    r = spark.sql("SELECT greek_decode('graeca', 'kai;').text AS t, greek_letters('aβγ1') AS g, other_letters('aβγ1') AS o, is_greek('β') AS b").first()
    assert tuple(r) == ("καὶ", 2, 1, True)


def test_null_and_empty_tokens(spark):
    d = spark.createDataFrame([("graeca", None, 1), ("graeca", "", 2), ("nosuch", "x", 3), ("graeca", "λόγος", 4)], "table_id string, token string, text int")
    got = {r[2]: r for r in decode_tokens(d.withColumnRenamed("text", "n")).collect()}
    assert got[1].text is None and got[2].text == "" and got[2].confidence == 1.0 and got[3].text is None and got[4].text == "λόγος"
