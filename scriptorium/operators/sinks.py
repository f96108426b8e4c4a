"""Pages and texts in their output forms: JSON, Markdown and plain text, one string a page or document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keytables import ENCODINGS
from .decode import decode_tokens
from .fonts import family_lines, table_of

PAGE = ["doc_id", "page_no"]
KEEP_NULLS = {"ignoreNullFields": "false"}


def _listed(rows: DataFrame, order: str, value: Column, *more: Column) -> DataFrame:
    """doc_id, page_no, vs and the aggregates `more`: `value` of each page's rows in order."""
    return rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("vs"), *more).withColumn("vs", F.transform("vs", lambda x: x["v"]))


def page_json(bands: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, json of every page, blank ones too."""
    box = F.array(*(F.bround(F.col(f"bbox.{c}"), 1) for c in ("x0", "y0", "x1", "y1")))
    band = F.struct("layer", "confidence", "evidence", box.alias("bbox"), "inline_refs", "text")
    listed = _listed(bands, "band_no", band, F.max("printed_page").alias("printed_page")).withColumnRenamed("vs", "bands")
    p = pages.select(*PAGE).distinct().join(listed, PAGE, "left")
    out = F.struct(F.col("page_no").alias("page"), "printed_page", F.coalesce("bands", F.array().cast(listed.schema["bands"].dataType)).alias("bands"))
    return p.select(*PAGE, F.to_json(out, KEEP_NULLS).alias("json"))


def page_markdown(bands: DataFrame) -> DataFrame:
    """doc_id, page_no, markdown of the pages that have bands: a section for each."""
    refs = F.when(F.size("inline_refs") > 0, F.concat(F.lit("  \n*refs: "), F.array_join("inline_refs", ", "), F.lit("*"))).otherwise("")
    section = F.concat(F.lit("### "), "layer", F.lit("  \n<sub>confidence "), F.format_number("confidence", 2), F.lit(" — "), "evidence", F.lit("</sub>"), refs, F.lit("\n\n"), "text", F.lit("\n"))
    head = F.concat(F.lit("## PDF page "), F.col("page_no").cast("string"), F.coalesce(F.concat(F.lit(" — printed page "), "p"), F.lit("")), F.lit("\n"))
    return _listed(bands, "band_no", section, F.max("printed_page").alias("p")).select(*PAGE, F.concat(head, F.lit("\n"), F.array_join("vs", "\n")).alias("markdown"))


def layer_text(bands: DataFrame, layer: str) -> DataFrame:
    """doc_id, page_no, text of one layer, of the pages that have it."""
    return _listed(bands.where(F.col("layer") == layer), "band_no", F.col("text")).select(*PAGE, F.array_join("vs", "\n").alias("text"))


def _line_tokens(table_id: str) -> Column:
    return F.flatten(F.transform(T.repair(F.col("ls"), table_id), lambda x: T.tokens(x, table_id)))


def decode_pages(run_rows: DataFrame) -> DataFrame:
    """doc_id, page_no, family_no, table_id, tok_no, token, text, unmapped, records, confidence of pages of font runs.

    Lines are repaired and split within each font family of a page, families in the order in which they first appear."""
    first = run_rows.withColumn("table_id", table_of(F.col("font"))).where("table_id is not null").groupBy(*PAGE, "table_id").agg(F.min(F.struct("line_no", "run_no")).alias("at"))
    order = first.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("at", "table_id"))).alias("f")).select(*PAGE, F.posexplode("f").alias("family_no", "f")).select(*PAGE, "family_no", F.col("f.table_id"))
    fam = family_lines(run_rows).groupBy(*PAGE, "table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("ls")).join(order, [*PAGE, "table_id"])
    toks = F.lit(None).cast("array<string>")
    for e in ENCODINGS:
        toks = F.when(F.col("table_id") == e.table_id, _line_tokens(e.table_id)).otherwise(toks)
    return decode_tokens(fam.select(*PAGE, "family_no", "table_id", F.posexplode(toks).alias("tok_no", "token")), passthrough=False)


def _ordered(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("k", F.struct("family_no", "tok_no"))


def page_tokens_json(tokens: DataFrame) -> DataFrame:
    """doc_id, page_no, json of decoded pages: every token with its least confidence."""
    font = F.create_map(*(F.lit(v) for e in ENCODINGS for v in (e.table_id, e.font)))
    tok = F.struct(F.col("token").alias("source"), "text", font[F.col("table_id")].alias("font"), (F.size("unmapped") == 0).alias("fully_mapped"), "unmapped", "confidence")
    return _listed(_ordered(tokens), "k", tok).select(*PAGE, F.to_json(F.struct(F.col("page_no").alias("page"), F.col("vs").alias("tokens")), KEEP_NULLS).alias("json"))


def page_text(tokens: DataFrame) -> DataFrame:
    """doc_id, page_no, text of decoded pages: a heading line and the words."""
    return _listed(_ordered(tokens), "k", F.col("text")).select(*PAGE, F.concat(F.lit("--- page "), F.col("page_no").cast("string"), F.lit("\n"), F.array_join("vs", " ")).alias("text"))


def token_warnings(tokens: DataFrame) -> DataFrame:
    """doc_id, page_no, n, first of the pages with unmapped codes: how many tokens have some, and the first ten."""
    return _listed(_ordered(tokens).where(F.size("unmapped") > 0), "k", F.col("token"), F.count("*").alias("n")).select(*PAGE, "n", F.slice("vs", 1, 10).alias("first"))


# What is said of a page.
BLANK_PAGE = "no extractable text layer (blank page, or a scanned image without OCR)"
RAW_CIDS = "this PDF's font has no usable character map — output contains raw (cid:N) glyph codes, not text, and cannot be decoded (no ToUnicode and no known table)"


def page_warnings(bands: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, blank, raw_cids of every page: whether it has no bands, or glyph codes in its text."""
    raw = F.bool_or(F.col("layer").isin("greek_text", "translation") & F.col("text").contains("(cid:"))
    found = bands.groupBy(*PAGE).agg(raw.alias("raw_cids"), F.lit(False).alias("blank"))
    return pages.select(*PAGE).distinct().join(found, PAGE, "left").select(*PAGE, F.coalesce("blank", F.lit(True)).alias("blank"), F.coalesce("raw_cids", F.lit(False)).alias("raw_cids"))


def text_json(decoded: DataFrame) -> DataFrame:
    """doc_id, json of decoded documents; those whose table was found have their five likeliest ones."""
    out = decoded.select("doc_id", F.col("table_id").alias("encoding"), "text", "fully_mapped", "unmapped_total", *(["detection"] if "detection" in decoded.columns else []))
    none = F.array().cast("array<struct<table_id:string,score:double>>")
    top = F.transform(F.slice("detection", 1, 5), lambda s: F.struct(s["table_id"].alias("table_id"), F.round(s["score"], 4).alias("score"))) if "detection" in decoded.columns else none
    return out.select("doc_id", F.to_json(F.struct("encoding", "text", "fully_mapped", "unmapped_total", top.alias("detection")), KEEP_NULLS).alias("json"))
