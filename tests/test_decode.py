import random
import re
import unicodedata

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.keytables import BY_ID, ENCODINGS
from scriptorium.operators.decode import decode_distinct, decode_text

# Words in the keys of their fonts, and what they read.
GOLDEN = {
    "graeca": {"Peripatou'ntiv": "Περιπατοῦντί", "e{wqen": "ἕωθεν", "ejn": "ἐν", "toi'\"": "τοῖς", "aujtw'/": "αὐτῷ", "oiJ": "οἱ", "fivloi": "φίλοι", "jEdidavcqhn": "Ἐδιδάχθην", "[Argei": "Ἄργει", "ou\\n": "οὖν", "kai;": "καὶ", "d!": "δ’", "Truvfwn": "Τρύφων", "yuchvn": "ψυχήν", "ejxei'pen": "ἐξεῖπεν", "cai're": "χαῖρε", "JHsai?a\"": "Ἡσαΐας", "Daui?d": "Δαυΐδ", "prwi?": "πρωΐ"},
    "bwgrkl": {"pi,stij": "πίστις", "qeou/": "θεοῦ", "pro.j": "πρὸς", "evleuqeri,a": "ἐλευθερία", "ca,rij": "χάρις", "kai,": "καί", "o`": "ὁ", "VIhsou/": "Ἰησοῦ", "avllV": "ἀλλ’", "qeou/.": "θεοῦ."},
    "odyssea": {'me";n': "μὲν", "toi`ı": "τοῖς", 'lo"go"': "λογος"},
    "timesgreek": {"xáriv": "χάρις", "qnjt¬ç": "θνητῷ", "ˆIjsoÕ": "Ἰησοῦ"},
    "spionic-ascii": {"u9ma~j": "ὑμᾶς", "pare/lqh|": "παρέλθῃ"},
}


def by_positions(e, token):
    """(text, records) of a word: for every position of it, where its character goes, found by scanning the others."""
    n = len(token)
    letter = {i: c for i, k in enumerate(token) if (c := e.letters.get(k) or (e.final_letter.get(k) if i == n - 1 else None))}
    base = {i: unicodedata.normalize("NFD", c)[0].lower() for i, c in letter.items()}
    is_mark = [k in e.marks and i not in letter and k not in e.final_letter for i, k in enumerate(token)]

    def home(i):
        carries = "αεηιουω" + ("ρ" if set(e.marks[token[i]]) <= {"\u0313", "\u0314"} else "")
        behind = [j for j in letter if j < i and base[j] in carries]
        return max(behind) if behind else min((j for j in letter if j > i), default=n)

    end, sign = n - 1, None
    before = max((j for j in range(end) if not is_mark[j]), default=None)
    vowel = before in letter and base[before] in "αεηιουω"
    if is_mark[end] and token[end] in e.final_apostrophe and before in letter and not vowel:
        sign = "’"
    elif is_mark[end] and token[end] in e.final_punct:
        accents = [j for j in range(end) if is_mark[j] and set(e.marks[token[j]]) & set("\u0300\u0301\u0342") and home(j) < end]
        sign = e.final_punct[token[end]] if accents or not vowel else None
    moved = {i: home(i) for i in range(n) if is_mark[i] and not (sign and i == end)}
    records = []
    for at in [i for i in range(n) if i not in moved] + [n] * (n in moved.values()):
        body = "" if at == n else letter.get(at) or (sign if sign and at == end else e.literals.get(token[at], "" if token[at] in e.final_letter else token[at]))
        early, late = ([i for i in sorted(moved) if moved[i] == at and (i < at) == first] for first in (True, False))
        marks = [m for i in early for m in e.marks[token[i]]]
        for m in (m for i in late for m in e.marks[token[i]]):
            marks += [m] * (m not in marks)
        known = at < n and (at in letter or is_mark[at] or token[at] in e.literals or token[at] in e.final_letter)
        records.append((unicodedata.normalize("NFC", body + "".join(marks)), "".join(token[i] for i in [at] * (at < n) + early + late), known))
    text = unicodedata.normalize("NFC", "".join(r[0] for r in records))
    word, tail = (lambda m: (m[1], m[2]))(re.fullmatch("(.*?)([’·.,;·]*)", text, re.S))
    return (word[:-1] + "ς" if word.endswith("σ") else word) + tail, records


def decoded(spark, rows):
    got = decode_distinct(spark.createDataFrame(rows, "table_id string, token string")).collect()
    return {(r["table_id"], r["token"]): r for r in got}


def test_golden_words(spark):
    got = decoded(spark, [(t, w) for t, ws in GOLDEN.items() for w in ws])
    assert {k: r["text"] for k, r in got.items()} == {(t, w): x for t, ws in GOLDEN.items() for w, x in ws.items()}
    assert not any(r["unmapped"] for k, r in got.items())


def test_kernel_agrees_with_scanning_positions(spark):
    rng = random.Random(5)
    words = []
    for e in ENCODINGS:
        keys = [*e.keys(), "Ø", "v", "J", "1"]
        words += [(e.table_id, "".join(rng.choice(keys) for _ in range(rng.randint(1, 12)))) for _ in range(150)]
    got = decoded(spark, words)
    for t, w in set(words):
        text, records = by_positions(BY_ID[t], w)
        r = got[t, w]
        assert (r["text"], [(x["output"], x["source"], x["mapped"]) for x in r["records"]]) == (text, records), (t, w)


def test_unmapped_is_kept_and_flagged(spark):
    r = decoded(spark, [("graeca", "kaiØ")])["graeca", "kaiØ"]
    assert "Ø" in r["text"] and r["unmapped"] == ["Ø"] and r["confidence"] == 0.0


def test_lines_are_repaired(spark):
    def fixed(lines, table="graeca"):
        return spark.createDataFrame([(lines,)], "x array<string>").select(T.repair(F.col("x"), table).alias("y")).first()["y"]

    assert fixed(["ejn pneuvmati aJgivw", "/ tou' qeou'"]) == ["ejn pneuvmati aJgivw/", "tou' qeou'"]
    assert fixed(['ejk panto;" filo-', 'sofiva" gevnoito']) == ['ejk panto;" filosofiva" gevnoito']
    assert fixed(["fi- -losofiva"]) == ["filosofiva"]
    assert fixed(["a-", "-b-", "c"]) == ["abc"]


def test_texts(spark):
    docs = spark.createDataFrame([(1, "i3na mh\\ pare/lqh| u9ma~j o9 peirasmo/j"), (2, "qeo/j e0stin"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decode_text(docs, "spionic-ascii").collect()}
    assert got[1]["text"] == "ἵνα μὴ παρέλθῃ ὑμᾶς ὁ πειρασμός" and not got[1]["warning"]
    assert got[2]["text"] == "θεός ἐστιν" and got[3]["text"] == ""
    docs = spark.createDataFrame([(1, "kai; ἤδη λόγος tou'to"), (2, "hello world plain text here"), (3, "ejn\n\npneuvmati")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decode_text(docs, "graeca").collect()}
    assert got[1]["text"] == "καὶ ἤδη λόγος τοῦτο" and got[1]["fully_mapped"] and got[2]["warning"] and got[3]["text"] == "ἐν\n\nπνεύματι"
