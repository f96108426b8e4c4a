"""Decoding legacy tokens and whole texts to polytonic Greek.

The kernel (`functions/kernel.py`) decodes a batch of tokens at once. Nothing here shuffles: a
token is decoded where it stands, a text in its own row, so rows with null or repeated ids stay
apart and every other column is carried along.

Defined cases: a null or empty text decodes to ''; a null token to null; an empty token to ''
without records and with confidence 1.0; a table without rows gives none."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import kernel as K
from ..functions import text as T
from ..functions.keytables import BY_ID, ENCODINGS

RECORD = StructType().add("output", "string").add("source", "string").add("mapped", "boolean").add("confidence", "double")
DECODED = StructType().add("text", "string").add("unmapped", ArrayType(StringType())).add("records", ArrayType(RECORD)).add("confidence", "double")
_RECORD = pa.struct([("output", pa.string()), ("source", pa.string()), ("mapped", pa.bool_()), ("confidence", pa.float64())])
_DECODED = pa.struct([("text", pa.string()), ("unmapped", pa.list_(pa.string())), ("records", pa.list_(_RECORD)), ("confidence", pa.float64())])
#: Texts of a slice are decoded together; it ends at about so many characters.
SLICE = 1 << 20
#: Chunks of text between spaces whose decoding a worker remembers, at most.
REMEMBERED = 1 << 17
# What a caller is told.
TRANSLITERATED = "almost no diacritic key codes in the input: this looks like plain Latin-alphabet text, and the output is most likely a transliteration artefact, not recovered Greek"
REFUSED = "input does not look like legacy-encoded Greek: no (or almost no) diacritic key codes found — plain Latin-alphabet prose would be transliterated into pseudo-Greek, which this tool refuses to do. Name the encoding if you are certain."


@F.arrow_udf(StringType())
def nfc(x: pa.Array) -> pa.Array:
    """NFC, which has no built-in function."""
    return pa.array([None if s is None else unicodedata.normalize("NFC", s) for s in x.to_pylist()], pa.string())


@F.arrow_udf(DECODED)
def _decode(tables: pa.Array, tokens: pa.Array) -> pa.Array:
    ts, ws = tables.to_pylist(), tokens.to_pylist()
    distinct = list(dict.fromkeys((t, w) for t, w in zip(ts, ws, strict=True) if t in K.TABLE and w is not None))
    made = {}
    for i in range(0, len(distinct), 20_000):
        part = distinct[i : i + 20_000]
        out = K.decode([w for _, w in part], np.array([K.TABLE[t] for t, _ in part]))
        for key, (text, lost, records, conf) in zip(part, out, strict=True):
            made[key] = {"text": text, "unmapped": lost, "records": [dict(zip(("output", "source", "mapped", "confidence"), r, strict=True)) for r in records], "confidence": conf}
    return pa.array([made.get(k) for k in zip(ts, ws, strict=True)], _DECODED)


def decode_tokens(tokens: DataFrame, passthrough: bool = True) -> DataFrame:
    """`tokens` (table_id, token and other columns) with text, unmapped, records and confidence.

    records: output, source, mapped, confidence of every unit, in order; confidence is their
    least, 1.0 for none. With `passthrough`, a token that already has Greek characters is only
    normalised."""
    plain = T.is_greek(F.col("token")) if passthrough else F.lit(False)
    same = nfc(F.col("token"))
    record = F.array(F.struct(same.alias("output"), F.col("token").alias("source"), F.lit(True).alias("mapped"), F.lit(1.0).alias("confidence")))
    whole = F.struct(same.alias("text"), F.array().cast("array<string>").alias("unmapped"), record.alias("records"), F.lit(1.0).alias("confidence"))
    made = _decode(F.when(~plain, F.col("table_id")), F.col("token"))
    made = F.when(plain, whole).otherwise(made) if passthrough else made
    return tokens.withColumn("__d", made).select(*tokens.columns, "__d.text", "__d.unmapped", "__d.records", "__d.confidence")


def decode_distinct(tokens: DataFrame) -> DataFrame:
    """table_id, token, text, unmapped, records, confidence of each distinct (table_id, token)."""
    return decode_tokens(tokens.select("table_id", "token").distinct(), passthrough=False)


class _Chunks(dict):
    """What a chunk of text between spaces decodes to under one table: (text, tokens, unmapped, legacy tokens, coded ones)."""

    def __init__(self, table: int):
        self.table = table

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(chunks)
        if not new:
            return
        chunk, tokens = K.tokenize(new, self.table)
        greek = np.array([bool(K.GREEK.search(t)) for t in tokens], bool)
        legacy = np.array([not K.GREEK.match(t) for t in tokens], bool)
        keyed = K.coded(tokens, self.table)
        at = np.flatnonzero(~greek)
        words: list = [None] * len(tokens)
        for i, d in zip(at.tolist(), K.decode([tokens[i] for i in at], np.full(len(at), self.table)), strict=True):
            words[i] = (d[0], len(d[1]))
        for i in np.flatnonzero(greek).tolist():
            words[i] = (unicodedata.normalize("NFC", tokens[i]), 0)
        cut = np.searchsorted(chunk, np.arange(len(new) + 1)).tolist()
        for c, a, b in zip(new, cut, cut[1:], strict=False):
            ws = words[a:b]
            self[c] = (" ".join(w[0] for w in ws if w[0]), b - a, sum(w[1] for w in ws), int(legacy[a:b].sum()), int((legacy[a:b] & keyed[a:b]).sum()))


_CHUNKS = {i: _Chunks(i) for i in range(len(ENCODINGS))}


def _decode_lines(table: int, lines: list[list[str]]) -> tuple[str, int, int, int, int]:
    known, sums, out = _CHUNKS[table], [0, 0, 0, 0], []
    for chunks in lines:
        got = [known[c] for c in chunks]
        out.append(" ".join(g[0] for g in got if g[0]).strip())
        for k in range(4):
            sums[k] += sum(g[k + 1] for g in got)
    return ("\n".join(out).strip(), *sums)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with `__lines` and `__table` to batches with what the lines decode to."""
    for batch in batches:
        rest = [c for c in batch.schema.names if c not in ("__lines", "__table")]
        at = 0
        while at < batch.num_rows:
            held, rows = 0, []
            while at + len(rows) < batch.num_rows and held < SLICE:
                lines = batch.column("__lines")[at + len(rows)].as_py()
                rows.append([K.CHUNKS.findall(x) for x in lines or []])
                held += sum(map(len, lines or []))
            tables = [K.TABLE.get(t) for t in batch.column("__table").slice(at, len(rows)).to_pylist()]
            for t in {t for t in tables if t is not None}:
                _CHUNKS[t].learn({c for mine, lines in zip(tables, rows, strict=True) if mine == t for x in lines for c in x})
            got = [(None, None, None, None, None) if t is None else _decode_lines(t, lines) for t, lines in zip(tables, rows, strict=True)]
            text, n, lost, legacy, coded = zip(*got, strict=True)
            part = batch.slice(at, len(rows))
            warned = [TRANSLITERATED if a and c / a < 0.05 else None for a, c in zip(legacy, coded, strict=True)]
            columns = [*(part.column(c) for c in rest), pa.array(text, pa.string()), batch.column("__table").slice(at, len(rows)), pa.array(n, pa.int64()), pa.array(lost, pa.int64()),
                       pa.array([None if x is None else x == 0 for x in lost], pa.bool_()), pa.array(warned, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "text", "table_id", "n_words", "unmapped_total", "fully_mapped", "warning"])
            at += len(rows)


def _repaired(table: Column, lines: Column) -> Column:
    """`lines` with broken words joined, by the marks of the table of the row."""
    out = F.lit(None).cast("array<string>")
    for e in ENCODINGS:
        out = F.when(table == e.table_id, T.repair(lines, e.table_id)).otherwise(out)
    return out


def decode_rows(rows: DataFrame, text: Column, table: Column, keep: list[str]) -> DataFrame:
    """`keep` columns of every row and text, table_id, n_words, unmapped_total, fully_mapped, warning; a null table decodes nothing."""
    named = rows.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], _repaired(table, T.lines(F.coalesce(text, F.lit("")))).alias("__lines"), table.alias("__table"))
    fields = ", ".join(f"__k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = named.mapInArrow(_texts, f"{fields}, text string, table_id string, n_words long, unmapped_total long, fully_mapped boolean, warning string")
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "text", "table_id", "n_words", "unmapped_total", "fully_mapped", "warning")


def decode_text(docs: DataFrame, table_id: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, table_id, n_words, unmapped_total, fully_mapped, warning of every row of `docs`.

    Without a table each row is decoded under its likeliest one, and score, detection (the
    ranking) and refusal follow: a text that does not look encoded has a refusal and no text."""
    if table_id is None:
        from .detect import ranked

        r = ranked(docs, id_col, text_col, keep=[text_col])
        r = r.withColumn("refusal", F.when(F.col("refused"), F.lit(REFUSED)))
        r = r.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__raw"), F.when(~F.col("refused"), F.col("table_id")).alias("__best"), "score", "detection", "refusal")
        out = decode_rows(r, F.col("__raw"), F.col("__best"), ["__id", "score", "detection", "refusal"])
        return out.select(F.col("__id").alias(id_col), "text", "table_id", "n_words", "unmapped_total", "fully_mapped", "warning", "score", "detection", "refusal")
    if table_id not in BY_ID:
        raise KeyError(f"unknown encoding {table_id!r}; known: {', '.join(sorted(BY_ID))}")
    return decode_rows(docs, F.col(text_col), F.lit(table_id), [id_col])
