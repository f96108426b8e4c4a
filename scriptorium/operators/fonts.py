"""Fonts to tables, and font runs of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keytables import BY_ID, ENCODINGS


def strip_subset(font: Column) -> Column:
    """A font's name without its subset tag: six upper-case characters and a plus."""
    head = F.substring(font, 1, 6)
    tagged = (F.length(font) > 7) & (F.substring(font, 7, 1) == "+") & (head == F.upper(head)) & head.rlike(r"\p{Lu}")
    return F.when(tagged, F.substr(font, F.lit(8))).otherwise(font)


def table_of(font: Column) -> Column:
    """The table of a font: the longest prefix wins, then registry order; null for an unknown font."""
    out, name = F.lit(None).cast("string"), strip_subset(font)
    for prefix, table_id in sorted(((p, e.table_id) for e in ENCODINGS for p in e.prefixes), key=lambda x: len(x[0])):
        out = F.when(F.startswith(name, F.lit(prefix)), table_id).otherwise(out)
    return out


def match(fonts: DataFrame) -> DataFrame:
    """font, table_id of every distinct font."""
    return fonts.select("font").distinct().withColumn("table_id", table_of(F.col("font")))


def cid_text(text: Column) -> Column:
    """(cid:N) as the character N; other text as it is."""
    n = F.regexp_extract(text, r"^\(cid:([0-9]+)\)$", 1)
    return F.when(n != "", F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 8, "0")), "UTF-32")).otherwise(text)


def companion(text: Column, font: Column, table_id: str) -> Column:
    """Characters of a table's accent fonts, moved to the private-use area; white space stays."""
    e = BY_ID[table_id]
    if not e.accent_fonts:
        return text
    src = "".join(chr(c) for c in range(33, 256) if not chr(c).isspace())
    accent = F.lit(False)
    for p in e.accent_fonts:
        accent = accent | font.startswith(p)
    return F.when(accent, F.translate(text, src, "".join(chr(e.accent_offset + ord(c)) for c in src))).otherwise(text)


def runs(glyphs: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, run_no, font, text: neighbouring glyphs of one font on a line.

    glyphs has doc_id, page_no, line_no, glyph_no, font, text."""
    line = ["doc_id", "page_no", "line_no"]
    w = Window.partitionBy(*line).orderBy("glyph_no")
    g = glyphs.withColumn("font", strip_subset(F.col("font"))).withColumn("text", cid_text(F.col("text")))
    g = g.withColumn("new", F.coalesce((F.col("font") != F.lag("font").over(w)).cast("int"), F.lit(1)))
    g = g.withColumn("run_no", (F.sum("new").over(w) - 1).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("glyph_no", "text"))), lambda x: x["text"]), "")
    return g.groupBy(*line, "run_no", "font").agg(text.alias("text")).select(*line, "run_no", "font", "text")


def family_lines(run_rows: DataFrame) -> DataFrame:
    """doc_id, page_no, table_id, line_no, text: what each known font family has on each line.

    A run in an unknown font leaves a space in every family that the line has opened before it."""
    line = ["doc_id", "page_no", "line_no"]
    known = run_rows.withColumn("table_id", table_of(F.col("font")))
    shifted = F.col("text")
    for e in ENCODINGS:
        if e.accent_fonts:
            shifted = F.when(F.col("table_id") == e.table_id, companion(F.col("text"), F.col("font"), e.table_id)).otherwise(shifted)
    known = known.withColumn("text", shifted)
    opened = known.where("table_id is not null").groupBy(*line, "table_id").agg(F.min("run_no").alias("opened"))
    gaps = known.where("table_id is null").select(*line, "run_no", F.lit(" ").alias("text")).join(opened, line).where("run_no > opened").select(*line, "table_id", "run_no", "text")
    parts = known.where("table_id is not null").select(*line, "table_id", "run_no", "text").union(gaps)
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "text"))), lambda x: x["text"]), ""))
    return parts.groupBy(*line, "table_id").agg(text.alias("text")).where("text <> ''").select("doc_id", "page_no", "table_id", "line_no", "text")


def census(run_rows: DataFrame, pages: int = 20) -> DataFrame:
    """font, n_chars of the known legacy fonts in the first pages."""
    return run_rows.where((F.col("page_no") < pages) & table_of(F.col("font")).isNotNull()).groupBy("font").agg(F.sum(F.length("text")).alias("n_chars"))


def fonts_by_count(counts: DataFrame) -> DataFrame:
    """font, n_chars of a census, the most used first, then by name."""
    return counts.orderBy(F.desc("n_chars"), "font")


def pitch(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, pitch: the commonest distance of neighbouring baselines, 12 without any.

    lines has doc_id, page_no, line_no, y0; ties go to the distance seen first."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    d = lines.withColumn("d", F.lag("y0").over(w) - F.col("y0")).withColumn("v", F.when((F.col("d") > 0) & (F.col("d") < 40), F.bround("d", 0)))
    n = d.groupBy("doc_id", "page_no", "v").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    best = F.max_by(F.col("v"), F.when(F.col("v").isNotNull(), F.struct("n", -F.col("first"))))
    return n.groupBy("doc_id", "page_no").agg(F.coalesce(best, F.lit(12.0)).alias("p")).select("doc_id", "page_no", F.when(F.col("p") == 0, 12.0).otherwise(F.col("p")).alias("pitch"))
