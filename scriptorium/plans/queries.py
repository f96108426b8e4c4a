"""Named queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keytables as K
from ..functions import text as T
from ..operators import decode, detect, fonts, layers, sinks

TEXT_TABLES = [e.table_id for e in K.ENCODINGS if not e.cid]
FONTS = ["Graeca", "DBGFPI+Graeca", "GraecaII-Bold", "ABCDEF+GraecaII", "abcdef+Graeca", "SymbolGreekIIP", "SymbolGreek", "GrecAccUn", "SPIonic", "Garamond", "A1BCDE+Odyssea", "123456+Bwgrkl", "TimesGreek,Italic"]
WORDS = [
    ("graeca", "Peripatou'ntiv"), ("graeca", "e{wqen"), ("graeca", "toi'\""), ("graeca", "aujtw'/"), ("graeca", "jEdidavcqhn"), ("graeca", "ou\\n"), ("graeca", "d!"), ("graeca", "JHsai?a\""), ("graeca", "kaiØ"),
    ("bwgrkl", "pi,stij"), ("bwgrkl", "VIhsou/"), ("bwgrkl", "avllV"), ("bwgrkl", "qeou/."), ("odyssea", 'me";n'), ("odyssea", "toi`ı"), ("odyssea", 'lo"go"'), ("timesgreek", "qnjt¬ç"), ("spionic-ascii", "pare/lqh|"),
]
LINES = [("[fol. 94 v° : A] kai", 1), ("xii", 2), ("XII", 3), ("12 - 14", 4), ("civil", 5), (". . .", 6), ("[p. 3] and [PG 12, 4] [x. 1]", 7)]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], cols: str) -> str:
    lit = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v).lower()
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) AS t({cols}))"


KEYMAP_COLS = "table_id, ch, kind, out, marks, final_punct, final_apostrophe, vowel, rho, breathing, accent, conf"


def kernel_sql(tokens: str) -> str:
    """CTEs that end in `decoded` (table_id, token, text, n_unmapped, confidence) for a query of (table_id, token)."""
    return f"""
keymap AS {values(K.keymap_rows(), KEYMAP_COLS)},
toks AS (SELECT DISTINCT table_id, token FROM ({tokens}) WHERE token <> ''),
chars AS (SELECT table_id, token, pos, substring(token, pos + 1, 1) AS ch FROM (SELECT table_id, token, unnest(range(length(token))) AS pos FROM toks)),
k AS (SELECT c.table_id, c.token, c.pos, c.ch, coalesce(m.kind, 'unmapped') AS kind, m.out, m.marks, m.final_punct, coalesce(m.final_apostrophe, false) AS fa, coalesce(m.vowel, false) AS vowel,
  coalesce(m.rho, false) AS rho, coalesce(m.breathing, false) AS breathing, coalesce(m.accent, false) AS accent, m.conf, max(pos) OVER (PARTITION BY c.table_id, c.token) AS n
  FROM chars c LEFT JOIN keymap m ON c.table_id = m.table_id AND c.ch = m.ch),
l AS (SELECT *, pos = n AS last, kind = 'letter' OR (kind = 'final_letter' AND pos = n) AS letter FROM k),
w AS (SELECT *, max(CASE WHEN letter AND vowel THEN pos END) OVER b AS vb, max(CASE WHEN letter AND rho THEN pos END) OVER b AS rb, min(CASE WHEN letter THEN pos END) OVER a AS la,
  max(CASE WHEN kind <> 'mark' THEN pos * 4 + CASE WHEN letter THEN 2 ELSE 0 END + CASE WHEN letter AND vowel THEN 1 ELSE 0 END END) OVER b AS ub
  FROM l WINDOW b AS (PARTITION BY table_id, token ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY table_id, token ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
x AS (SELECT *, CASE WHEN kind = 'mark' THEN coalesce(CASE WHEN breathing THEN greatest(vb, rb) ELSE vb END, la) END AS target, coalesce(ub % 4 >= 2, false) AS pl, coalesce(ub % 4 = 3, false) AS pv FROM w),
y AS (SELECT *, coalesce(max(CASE WHEN kind = 'mark' AND accent AND target < n THEN 1 END) OVER (PARTITION BY table_id, token ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS accented FROM x),
z AS (SELECT *, CASE WHEN last AND fa AND pl AND NOT pv THEN '’' WHEN last AND final_punct IS NOT NULL AND (NOT pv OR accented) THEN final_punct WHEN kind = 'literal' THEN out END AS lit FROM y),
z2 AS (SELECT *, kind = 'mark' AND lit IS NULL AS is_mark FROM z),
z3 AS (SELECT *, CASE WHEN is_mark AND target IS NULL THEN n + 1 WHEN is_mark THEN target ELSE pos END AS unit_no, is_mark AND (target IS NULL OR target > pos) AS queued,
  CASE WHEN letter THEN out WHEN lit IS NOT NULL THEN lit WHEN kind = 'unmapped' THEN ch ELSE '' END AS body, NOT (is_mark AND target IS NULL) AND kind <> 'unmapped' AS mapped FROM z2),
u AS (SELECT table_id, token, unit_no, max(CASE WHEN is_mark THEN '' ELSE body END) AS body, coalesce(string_agg(marks, '' ORDER BY pos) FILTER (WHERE is_mark AND queued), '') AS pre,
  coalesce(string_agg(marks, '' ORDER BY pos) FILTER (WHERE is_mark AND NOT queued), '') AS post, count(*) FILTER (WHERE NOT mapped) AS lost,
  min(CASE WHEN NOT mapped THEN 0.0 WHEN is_mark AND queued THEN 1.0 ELSE conf END) AS conf FROM z3 GROUP BY ALL),
v AS (SELECT *, nfc_normalize(body || list_reduce(list_transform(range(1, length(post) + 1), lambda i: substring(post, i, 1)), lambda acc, m: CASE WHEN contains(acc, m) THEN acc ELSE acc || m END, pre)) AS seg FROM u),
decoded AS (SELECT table_id, token, regexp_replace(nfc_normalize(string_agg(seg, '' ORDER BY unit_no)), 'σ([’·.,;·]*)$', 'ς\\1') AS text, CAST(sum(lost) AS BIGINT) AS n_unmapped, CAST(min(conf) AS DOUBLE) AS confidence FROM v GROUP BY ALL)"""


def tokens_sql(line: str, table_id: str) -> str:
    e = K.BY_ID[table_id]
    return f"list_filter(list_transform(string_split_regex({line}, {q(T.separator_regex(e))}), lambda t: trim(t, '-')), lambda t: regexp_matches(t, {q(T.keep_regex(e))}))"


def lines_sql(text: str) -> str:
    parts = f"string_split_regex({text}, {q(T.LINE_END)})"
    return f"CASE WHEN len({parts}) > 1 AND {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def repair_sql(lines: str, marks: str) -> str:
    """The repaired lines of a list of lines: a fold over the text made so far, which starts as chr(1)."""
    blank = T.SPACE + r"\x0B\f\x1C-\x1F\x{0085}\x{1680}\x{2028}\x{2029}"
    insert = "'([A-Za-z])-[ ]+-([A-Za-z])', '\\1\\2', 'g'"
    x = f"regexp_replace(regexp_replace(x, {insert}), {insert})"
    moved = f"regexp_extract({x}, {q(f'^([{T.char_class(marks)}]+)([{T.SPACE}]|$)')}, 1)"
    moves = f"({moved} <> '' AND a <> chr(1) AND regexp_matches(regexp_extract(a, '[^\n]*$'), {q(f'[{T.WORD}]')}))"
    text = f"CASE WHEN {moves} THEN regexp_replace(a, {q(f'[{blank}]+$')}, '') || {moved} ELSE a END"
    rest = f"CASE WHEN {moves} THEN regexp_replace(substring({x}, length({moved}) + 1), {q(f'^[{blank}]+')}, '') ELSE {x} END"
    step = f"""CASE WHEN a = chr(1) THEN {x} WHEN {moves} AND {rest} = '' THEN {text} WHEN ends_with({text}, '-') THEN regexp_replace({text}, '-$', '') || regexp_replace({rest}, '^-+', '')
  ELSE ({text}) || chr(10) || ({rest}) END"""
    return f"string_split(list_reduce(list_prepend(chr(1), {lines}), lambda a, x: {step}), chr(10))"


def marks_of(table_id: str) -> str:
    return "".join(K.BY_ID[table_id].marks)


def text_sql(rows: str, tables: list[str]) -> str:
    """CTEs that end in `texts` (r, text, n_words, unmapped_total, warned) for a query of (r, table_id, text) under any of `tables`."""
    each = " UNION ALL ".join(f"SELECT r, table_id, {repair_sql(lines_sql('text'), marks_of(t))} AS l FROM raw WHERE table_id = {q(t)}" for t in tables)
    toks = " ".join(f"WHEN {q(t)} THEN {tokens_sql('line', t)}" for t in tables)
    coded = " ".join(f"WHEN {q(t)} THEN regexp_matches(token, {q('[' + T.char_class(marks_of(t)) + ']')})" for t in tables)
    greek = q(f"[{T.GREEK}]")
    return f"""raw AS ({rows}), ls AS ({each}),
li AS (SELECT r, table_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM ls), tk AS (SELECT r, table_id, i, CASE table_id {toks} END AS ts FROM li),
tt AS (SELECT r, table_id, i, unnest(range(len(ts))) AS p, unnest(ts) AS token FROM tk),
{kernel_sql(f"SELECT table_id, token FROM tt WHERE NOT regexp_matches(token, {greek})")},
wd AS (SELECT r, i, p, coalesce(d.text, nfc_normalize(t.token)) AS w, coalesce(n_unmapped, 0) AS lost, NOT regexp_matches(substring(t.token, 1, 1), {greek}) AS legacy, CASE t.table_id {coded.replace("token", "t.token")} END AS coded
  FROM tt t LEFT JOIN decoded d ON t.table_id = d.table_id AND t.token = d.token),
wl AS (SELECT r, i, trim(coalesce(string_agg(w, ' ' ORDER BY p) FILTER (WHERE w <> ''), '')) AS line, count(w) AS n, sum(lost) AS lost, count(*) FILTER (WHERE legacy) AS legacy, count(*) FILTER (WHERE legacy AND coded) AS coded
  FROM li LEFT JOIN wd USING (r, i) GROUP BY r, i),
texts AS (SELECT r, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)) AS text, CAST(sum(n) AS BIGINT) AS n_words, CAST(coalesce(sum(lost), 0) AS BIGINT) AS unmapped_total,
  sum(legacy) > 0 AND sum(coded) < 0.05 * sum(legacy) AS warned FROM wl GROUP BY r)"""


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenize(table_id: str):
    def run(spark, sf_dir):
        rows = T.token_rows(docs(spark, sf_dir), table_id, repaired=False)
        return rows.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))

    sql = f"""WITH l AS (SELECT doc_id, unnest({lines_sql("coalesce(text, '')")}) AS line FROM documents), t AS (SELECT doc_id, unnest({tokens_sql('line', table_id)}) AS token FROM l)
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY token"""
    return run, sql


def _decode_documents(table_id: str):
    def run(spark, sf_dir):
        rows = T.token_rows(docs(spark, sf_dir), table_id, repaired=False).groupBy("token").agg(F.count("*").alias("n")).withColumn("table_id", F.lit(table_id))
        d = decode.decode_tokens(rows, passthrough=False)
        return d.select("token", "text", "n", F.size("unmapped").cast("long").alias("n_unmapped"), "confidence")

    sql = f"""WITH ln AS (SELECT unnest({lines_sql("coalesce(text, '')")}) AS line FROM documents), t AS (SELECT unnest({tokens_sql('line', table_id)}) AS token FROM ln), c AS (SELECT token, count(*) AS n FROM t GROUP BY token),
{kernel_sql(f"SELECT {q(table_id)} AS table_id, token FROM c")}
SELECT c.token, d.text, c.n, d.n_unmapped, d.confidence FROM c JOIN decoded d ON c.token = d.token"""
    return run, sql


def golden(spark, sf_dir):
    d = decode.decode_distinct(spark.createDataFrame(WORDS, "table_id string, token string"))
    return d.select("table_id", "token", "text", F.size("unmapped").cast("long").alias("n_unmapped"), "confidence")


def records(spark, sf_dir):
    """Provenance of the benchmark's tokens: every record of every distinct token."""
    t = T.token_rows(docs(spark, sf_dir, "benchmark"), "graeca", "item_id").withColumn("table_id", F.lit("graeca"))
    return decode.decode_distinct(t).select("token", F.posexplode("records").alias("pos", "r")).select("token", "pos", "r.*")


RECORDS_SQL = f"""WITH rl AS (SELECT unnest({repair_sql(lines_sql("coalesce(text, '')"), marks_of("graeca"))}) AS line FROM benchmark), t AS (SELECT unnest({tokens_sql("line", "graeca")}) AS token FROM rl),
{kernel_sql("SELECT 'graeca' AS table_id, token FROM t")},
s AS (SELECT token, unit_no, string_agg(ch, '' ORDER BY is_mark, pos) AS source, bool_and(mapped) AS mapped FROM z3 GROUP BY ALL)
SELECT token, CAST(row_number() OVER (PARTITION BY token ORDER BY unit_no) - 1 AS INTEGER) AS pos, seg AS output, source, mapped, CAST(conf AS DOUBLE) AS confidence FROM s JOIN v USING (token, unit_no)"""


def decode_text_full(spark, sf_dir):
    """Every turn decoded under one table."""
    d = decode.decode_rows(docs(spark, sf_dir, "conversations"), F.col("text"), F.lit("spionic-ascii"), ["conv_id", "turn"])
    return d.select("conv_id", "turn", "text", "n_words", "unmapped_total", "fully_mapped", F.col("warning").isNotNull().alias("warned"))


TEXT_SQL = f"""WITH n AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(text, '') AS text FROM conversations), {text_sql("SELECT r, 'spionic-ascii' AS table_id, text FROM n", ["spionic-ascii"])}
SELECT conv_id, turn, t.text, n_words, unmapped_total, unmapped_total = 0 AS fully_mapped, warned FROM n JOIN texts t USING (r)"""


def decode_text_auto(spark, sf_dir):
    """Every document decoded under its likeliest table, or refused."""
    d = decode.decode_text(docs(spark, sf_dir))
    return d.select("doc_id", "table_id", F.round("score", 6).alias("score"), F.col("refusal").isNotNull().alias("refused"), F.md5("text").alias("digest"), "n_words", "unmapped_total", F.col("warning").isNotNull().alias("warned"))


def font_match(spark, sf_dir):
    return fonts.match(spark.createDataFrame([(f,) for f in FONTS], "font string"))


FONT_SQL = f"""WITH f AS {values([(f,) for f in FONTS], 'font')}, p AS {values([(e.table_id, p, i) for i, e in enumerate(K.ENCODINGS) for p in e.prefixes], 'table_id, prefix, reg_order')},
s AS (SELECT font, CASE WHEN length(font) > 7 AND font[7] = '+' AND upper(font[1:6]) = font[1:6] AND regexp_matches(font[1:6], '\\p{{Lu}}') THEN font[8:] ELSE font END AS name FROM f)
SELECT font, arg_max(table_id, {{'a': length(prefix), 'b': -reg_order}}) AS table_id FROM s LEFT JOIN p ON starts_with(name, prefix) GROUP BY font"""


def detect_scores(spark, sf_dir):
    s = detect.scores(docs(spark, sf_dir))
    return s.select("doc_id", "table_id", *(F.round(c, 6).alias(c) for c in ("score", "mapped_ratio", "greek_ratio", "code_token_ratio")))


def detect_by_lang(spark, sf_dir):
    return detect.best(docs(spark, sf_dir), keep=["lang"]).groupBy("lang", "table_id", "refused").agg(F.count("*").alias("n"))


def _score_sql() -> str:
    parts = [f"SELECT doc_id, {i} AS reg_order, {q(e.table_id)} AS table_id, {q('[' + T.char_class(''.join(e.marks)) + ']')} AS codes, {tokens_sql('s', e.table_id)} AS toks FROM sample" for i, e in enumerate(K.ENCODINGS) if not e.cid]
    return f"""WITH sample AS (SELECT doc_id, substring(coalesce(text, ''), 1, {detect.SAMPLE_CHARS}) AS s FROM documents), per AS ({' UNION ALL '.join(parts)}),
used AS (SELECT doc_id, table_id, unnest(toks[:{detect.SAMPLE_TOKENS}]) AS token FROM per),
{kernel_sql("SELECT table_id, token FROM used")},
sums AS (SELECT u.doc_id, u.table_id, sum(length(u.token) - d.n_unmapped) AS mapped, sum(length(d.text)) AS out_len, sum(length(regexp_replace(d.text, {q(f'[^{T.GREEK}]')}, '', 'g'))) AS greek
  FROM used u JOIN decoded d ON u.table_id = d.table_id AND u.token = d.token GROUP BY ALL),
base AS (SELECT doc_id, table_id, reg_order, greatest(coalesce(list_sum(list_transform(toks, lambda t: length(t))), 0), 1) AS n_in, len(toks) AS n_toks, len(list_filter(toks[:{detect.SAMPLE_TOKENS}], lambda t: regexp_matches(t, codes))) AS coded FROM per),
r AS (SELECT b.doc_id, b.table_id, b.reg_order, coalesce(CAST(mapped AS DOUBLE) / n_in, 0.0) AS mapped_ratio, CASE WHEN out_len > 0 THEN CAST(greek AS DOUBLE) / CAST(out_len AS DOUBLE) ELSE 0.0 END AS greek_ratio,
  CASE WHEN n_toks > 0 THEN CAST(coded AS DOUBLE) / n_toks ELSE 0.0 END AS code_token_ratio FROM base b LEFT JOIN sums s ON b.doc_id = s.doc_id AND b.table_id = s.table_id),
scored AS (SELECT *, mapped_ratio * greek_ratio * least(1.0, code_token_ratio / CAST(0.3 AS DOUBLE)) AS score FROM r)"""


DETECT_SQL = _score_sql() + " SELECT doc_id, table_id, round(score, 6) AS score, round(mapped_ratio, 6) AS mapped_ratio, round(greek_ratio, 6) AS greek_ratio, round(code_token_ratio, 6) AS code_token_ratio FROM scored"
BY_LANG_SQL = _score_sql() + f""", top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, reg_order) AS rank FROM scored)
SELECT lang, table_id, score = 0 OR code_token_ratio < {detect.LEAST_CODED} AS refused, count(*) AS n FROM top JOIN documents USING (doc_id) WHERE rank = 1 GROUP BY ALL"""


AUTO_SQL = f"""WITH n AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
best AS (SELECT r AS doc_id, table_id, score, score = 0 OR code_token_ratio < {detect.LEAST_CODED} AS refused FROM ({_score_sql().replace("SELECT doc_id, substring(coalesce(text, ''), 1, 4000) AS s FROM documents", "SELECT r AS doc_id, substring(text, 1, 4000) AS s FROM n")}
  SELECT doc_id AS r, table_id, score, code_token_ratio, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, reg_order) AS rank FROM scored) WHERE rank = 1),
{text_sql("SELECT n.r, table_id, text FROM n JOIN best ON n.r = best.doc_id WHERE NOT refused", TEXT_TABLES)}
SELECT n.doc_id, CASE WHEN NOT refused THEN table_id END AS table_id, round(score, 6) AS score, refused, md5(t.text) AS digest, n_words, unmapped_total, coalesce(warned, false) AS warned
FROM n JOIN best ON n.r = best.doc_id LEFT JOIN texts t ON n.r = t.r"""


def validate_greek(spark, sf_dir):
    return docs(spark, sf_dir, "pages").select("page_id", T.greek_letters(F.col("html")).cast("long").alias("greek"), T.other_letters(F.col("html")).cast("long").alias("other"))


GREEK_SQL = f"""SELECT page_id, length(regexp_replace(html, {q(f'[^{T.GREEK}]|[^' + chr(92) + 'p{L}]')}, '', 'g')) AS greek, length(regexp_replace(html, {q(f'[{T.GREEK}]|[^' + chr(92) + 'p{L}]')}, '', 'g')) AS other FROM pages"""


def line_tests(spark, sf_dir):
    d = spark.createDataFrame(LINES, "line string, n int")
    return d.select("n", F.array_join(T.inline_refs(F.col("line")), "|").alias("refs"), T.digits_only(F.col("line")).alias("digits_only"))


LINE_TESTS_SQL = f"SELECT n, array_to_string(regexp_extract_all(line, {q(T.INLINE_REF)}), '|') AS refs, regexp_matches(line, {q(T.DIGITS)}) AND regexp_matches(line, {q(T.DIGITS_SOME)}) AS digits_only FROM {values(LINES, 'line, n')}"


def digits_only_lines(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("line_no", "line"))
    return d.where(T.digits_only(F.col("line"))).select("doc_id", "line_no", "line")


DIGITS_SQL = f"""WITH l AS (SELECT doc_id, {lines_sql("coalesce(text, '')")} AS ls FROM documents), e AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM e WHERE regexp_matches(line, {q(T.DIGITS)}) AND regexp_matches(line, {q(T.DIGITS_SOME)})"""


def _runs(spark, sf_dir) -> DataFrame:
    """Every benchmark text as a page of font runs: each line's words alternate between two fonts."""
    d = docs(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    w = d.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("w", "word"))
    font = F.when((F.col("doc_id") + F.col("w")) % 3 == 0, "Garamond").when(F.col("doc_id") % 2 == 0, "GFDJFH+Graeca").otherwise("SPIonic")
    g = w.select("doc_id", (F.col("doc_id") % 30).cast("int").alias("page_no"), "line_no", "w", font.alias("font"), F.posexplode(F.filter(F.split("word", ""), lambda c: c != "")).alias("c", "text"))
    return fonts.runs(g.withColumn("glyph_no", F.col("w") * 10000 + F.col("c")))


def font_runs(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("doc_id", "page_no", "font").agg(F.count("*").alias("n_runs"), F.sum(F.length("text")).alias("n_chars"))


def font_census(spark, sf_dir):
    return fonts.census(_runs(spark, sf_dir))


_GLYPH_SQL = f"""WITH ls AS (SELECT item_id AS doc_id, {lines_sql('text')} AS l FROM benchmark), li AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM ls),
ws AS (SELECT doc_id, line_no, string_split(line, ' ') AS w FROM li), wo AS (SELECT doc_id, line_no, unnest(range(len(w))) AS w, unnest(w) AS word FROM ws),
g AS (SELECT doc_id, CAST(doc_id % 30 AS INTEGER) AS page_no, line_no, w, word, CASE WHEN (doc_id + w) % 3 = 0 THEN 'Garamond' WHEN doc_id % 2 = 0 THEN 'Graeca' ELSE 'SPIonic' END AS font FROM wo WHERE word <> ''),
n AS (SELECT *, CASE WHEN font IS DISTINCT FROM lag(font) OVER (PARTITION BY doc_id, line_no ORDER BY w) THEN 1 ELSE 0 END AS new FROM g)"""
RUNS_SQL = _GLYPH_SQL + " SELECT doc_id, page_no, font, CAST(sum(new) AS BIGINT) AS n_runs, CAST(sum(length(word)) AS BIGINT) AS n_chars FROM n GROUP BY ALL"
CENSUS_SQL = _GLYPH_SQL + " SELECT font, CAST(sum(length(word)) AS BIGINT) AS n_chars FROM n WHERE page_no < 20 AND font <> 'Garamond' GROUP BY font"


def page_families(spark, sf_dir):
    return fonts.family_lines(_runs(spark, sf_dir))


FAMILIES_SQL = _GLYPH_SQL + """, ru AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, line_no ORDER BY w) AS run FROM n),
f AS (SELECT doc_id, page_no, line_no, run, font, string_agg(word, '' ORDER BY w) AS text FROM ru GROUP BY ALL), o AS (SELECT doc_id, line_no, min(run) AS opened FROM f WHERE font <> 'Garamond' GROUP BY ALL),
j AS (SELECT doc_id, page_no, line_no, trim(string_agg(CASE WHEN font = 'Garamond' THEN ' ' ELSE text END, '' ORDER BY run)) AS text FROM f JOIN o USING (doc_id, line_no) WHERE run >= opened GROUP BY ALL)
SELECT doc_id, page_no, CASE WHEN doc_id % 2 = 0 THEN 'graeca' ELSE 'spionic-cid' END AS table_id, CAST(line_no AS INTEGER) AS line_no, text FROM j WHERE text <> ''"""


def page_pitch(spark, sf_dir):
    """Synthetic baselines: a line every 12 points, with a wider gap after every seventh."""
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("line_no", "line"))
    return fonts.pitch(d.select("doc_id", F.lit(0).alias("page_no"), "line_no", (700.0 - 12 * F.col("line_no") - 5 * F.floor(F.col("line_no") / 2)).alias("y0")))


PITCH_SQL = f"""WITH l AS (SELECT doc_id, {lines_sql("coalesce(text, '')")} AS ls FROM documents), e AS (SELECT doc_id, unnest(range(len(ls))) AS line_no FROM l), y AS (SELECT doc_id, line_no, 700.0 - 12 * line_no - 5 * floor(line_no / 2) AS y0 FROM e),
d AS (SELECT doc_id, line_no, lag(y0) OVER (PARTITION BY doc_id ORDER BY line_no) - y0 AS d FROM y), n AS (SELECT doc_id, round(d) AS v, count(*) AS n, min(line_no) AS first FROM d WHERE d > 0 AND d < 40 GROUP BY ALL),
b AS (SELECT doc_id, arg_max(v, {{'a': n, 'b': -first}}) AS p FROM n GROUP BY doc_id)
SELECT DISTINCT e.doc_id, 0 AS page_no, CAST(coalesce(p, 12.0) AS DOUBLE) AS pitch FROM e LEFT JOIN b ON e.doc_id = b.doc_id"""


def _pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every benchmark text as pages of glyphs: 30 lines of eight words in 10 points, then two smaller ones below a gap."""
    d = docs(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("w", "word"))
    at = F.floor(F.col("w") / 8)
    d = d.select("doc_id", (F.floor(at / 32)).cast("int").alias("page_no"), (at % 32).cast("int").alias("line_no"), "w", F.concat("word", F.lit(" ")).alias("word"))
    c = d.groupBy("doc_id", "page_no", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "word"))), lambda x: x["word"]), "").alias("line"))
    c = c.select("doc_id", "page_no", "line_no", F.posexplode(F.filter(F.split("line", ""), lambda x: x != "")).alias("glyph_no", "text"))
    size = F.when(F.col("line_no") < 30, 10.0).otherwise(8.0)
    x0, y0 = 133.0 + F.col("glyph_no") * size / 2, 700.0 - 12 * F.col("line_no") - F.when(F.col("line_no") < 30, 0.0).otherwise(24.0)
    g = c.select(
        "doc_id", "page_no", F.col("line_no").alias("box_no"), "line_no", "glyph_no", F.lit("char").alias("kind"), "text", F.when(F.col("doc_id") % 3 == 0, "GFDJFH+Graeca").otherwise("Garamond").alias("font"),
        size.alias("size"), x0.alias("x0"), (x0 + size / 2).alias("x1"), y0.alias("y0"), (y0 + size).alias("y1"), F.lit(0.0).alias("skew"),
    )
    return g, g.select("doc_id", "page_no", F.lit(595.0).alias("width"), F.lit(842.0).alias("height")).distinct()


def physical_lines(spark, sf_dir):
    return layers.physical_lines(*_pages(spark, sf_dir)).select("doc_id", "page_no", "line_no", "text", "size", F.round("y0", 6).alias("y0"))


LINES_SQL = """WITH w AS (SELECT item_id AS doc_id, string_split_regex(coalesce(text, ''), '\\s+') AS ws FROM benchmark), e AS (SELECT doc_id, unnest(range(len(ws))) AS w, unnest(ws) AS word FROM w),
l AS (SELECT doc_id, CAST(w // 256 AS INTEGER) AS page_no, CAST(w // 8 % 32 AS INTEGER) AS line_no, trim(string_agg(word, ' ' ORDER BY w)) AS text FROM e GROUP BY ALL)
SELECT doc_id, page_no, line_no, text, CAST(CASE WHEN line_no < 30 THEN 10 ELSE 8 END AS DOUBLE) AS size, CAST(700 - 12 * line_no - CASE WHEN line_no < 30 THEN 0 ELSE 24 END AS DOUBLE) AS y0 FROM l WHERE text <> ''"""


def page_bands(spark, sf_dir):
    return layers.classify(*_pages(spark, sf_dir))


def page_json(spark, sf_dir):
    g, p = _pages(spark, sf_dir)
    return sinks.page_json(layers.classify(g, p), p)


def page_markdown(spark, sf_dir):
    return sinks.page_markdown(page_bands(spark, sf_dir))


def layer_text(spark, sf_dir):
    return sinks.layer_text(page_bands(spark, sf_dir), "greek_text")


def page_tokens_json(spark, sf_dir):
    return sinks.page_tokens_json(sinks.decode_pages(_runs(spark, sf_dir)))


def text_json(spark, sf_dir):
    """Every turn as JSON, under its likeliest table."""
    d = docs(spark, sf_dir, "conversations").select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("doc_id"), "text")
    return sinks.text_json(decode.decode_text(d))


def page_text(spark, sf_dir):
    return sinks.page_text(sinks.decode_pages(_runs(spark, sf_dir)))


def page_has_greek(spark, sf_dir):
    return layers.has_legacy_greek(_pages(spark, sf_dir)[0])


HAS_GREEK_SQL = """WITH w AS (SELECT item_id AS doc_id, string_split_regex(coalesce(text, ''), '\\s+') AS ws FROM benchmark)
SELECT DISTINCT doc_id, CAST(unnest(range(len(ws))) // 256 AS INTEGER) AS page_no, doc_id % 3 = 0 AS has_legacy_greek FROM w"""


def encodings_dim(spark, sf_dir):
    return K.encodings(spark).select("table_id", "font", "cid", "n_letters", "n_codes").orderBy("table_id")


def keymap_profile(spark, sf_dir):
    return K.keymap(spark).groupBy("table_id", "kind").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf"))


def repair_lines(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.repair(T.lines(F.coalesce("text", F.lit(""))), "bwgrkl").alias("l"))
    return d.select("doc_id", F.size("l").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


REPAIR_SQL = f"""WITH l AS (SELECT doc_id, {repair_sql(lines_sql("coalesce(text, '')"), marks_of("bwgrkl"))} AS l FROM documents)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM l"""

QUERIES = {
    "decode_text_auto": decode_text_auto, "page_text": page_text, "page_has_greek": page_has_greek,
    "font_match": font_match, "encodings_dim": encodings_dim, "keymap_profile": keymap_profile, "decode_words_golden": golden, "decode_records": records, "decode_text_full": decode_text_full,
    "detect_scores": detect_scores, "detect_refusal_by_lang": detect_by_lang, "validate_greek": validate_greek, "line_tests": line_tests, "digits_only_lines": digits_only_lines, "runs_from_glyphs": font_runs,
    "font_census": font_census, "page_families": page_families, "page_pitch": page_pitch, "repair_lines": repair_lines,
    "physical_lines": physical_lines, "page_bands": page_bands, "page_json": page_json, "page_markdown": page_markdown, "layer_text": layer_text, "page_tokens_json": page_tokens_json, "text_json": text_json,
}
SQL = {
    "decode_records": RECORDS_SQL, "decode_text_full": TEXT_SQL, "decode_text_auto": AUTO_SQL, "repair_lines": REPAIR_SQL, "page_families": FAMILIES_SQL, "page_has_greek": HAS_GREEK_SQL,
    "font_match": FONT_SQL, "decode_words_golden": f"WITH {kernel_sql('SELECT * FROM ' + values(WORDS, 'table_id, token'))} SELECT * FROM decoded",
    "encodings_dim": "SELECT table_id, font, cid, CAST(n_letters AS INTEGER) AS n_letters, CAST(n_codes AS INTEGER) AS n_codes FROM " + values([(e.table_id, e.font, e.cid, len(e.letters), len(e.marks) + len(e.literals) + len(e.final_letter)) for e in K.ENCODINGS], "table_id, font, cid, n_letters, n_codes"),
    "keymap_profile": f"SELECT table_id, kind, count(*) AS n, round(avg(CAST(conf AS DOUBLE)), 6) AS conf FROM {values(K.keymap_rows(), KEYMAP_COLS)} GROUP BY ALL",
    "detect_scores": DETECT_SQL, "detect_refusal_by_lang": BY_LANG_SQL, "validate_greek": GREEK_SQL, "line_tests": LINE_TESTS_SQL, "digits_only_lines": DIGITS_SQL, "runs_from_glyphs": RUNS_SQL, "font_census": CENSUS_SQL, "page_pitch": PITCH_SQL, "physical_lines": LINES_SQL,
}
for _t in TEXT_TABLES:
    QUERIES[f"tokenize_{_t.replace('-', '_')}"], SQL[f"tokenize_{_t.replace('-', '_')}"] = _tokenize(_t)
for _t in ("graeca", "odyssea", "bwgrkl", "timesgreek", "spionic-ascii"):
    QUERIES[f"decode_documents_{_t.replace('-', '_')}"], SQL[f"decode_documents_{_t.replace('-', '_')}"] = _decode_documents(_t)
