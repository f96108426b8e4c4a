"""Command line: decode a text, or the pages of a file (a PDF, or layout trees as .jsonl).

Exit codes: 0 with output, 1 where pages gave none, 2 for a user's error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keytables import ENCODINGS
from .operators import fonts, layers, sinks
from .operators.decode import decode_text
from .sources import layout, pdf

CENSUS_PAGES = 20


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptorium", description="Decode texts in the keys of pre-Unicode Greek fonts")
    p.add_argument("pdf", nargs="?", help="a PDF file, or layout trees as .jsonl")
    p.add_argument("--text", help="decode this text")
    p.add_argument("--stdin", action="store_true", help="decode the whole standard input as one text")
    p.add_argument("--encoding", help="table of --text or --stdin (default: the likeliest)")
    p.add_argument("--list-encodings", action="store_true", help="list the tables")
    p.add_argument("--page", type=int, help="one page, counted from 0 (default: all)")
    p.add_argument("--json", action="store_true", help="JSON with provenance")
    p.add_argument("--layers", action="store_true", help="layers of each page as JSON")
    p.add_argument("--md", action="store_true", help="layers of each page as Markdown")
    p.add_argument("--layer", help="the text of one layer")
    p.add_argument("--list-fonts", action="store_true", help=f"legacy fonts of the first {CENSUS_PAGES} pages")
    return p


def say(*lines: str) -> None:
    for line in lines:
        print(line, file=sys.stderr)


def _text(spark: SparkSession, raw: str, encoding: str | None, as_json: bool) -> int:
    d = decode_text(spark.createDataFrame([(0, raw)], "doc_id long, text string"), encoding)
    r = d.first()
    if encoding is None and r["refusal"]:
        raise ValueError(r["refusal"])
    if as_json:
        print(sinks.text_json(d).first()["json"])
        return 0
    print(r["text"])
    if encoding is None:
        say(f"[encoding: {r['table_id']}, auto-detected]")
    if r["warning"]:
        say(f"[!] {r['warning']}")
    if not r["fully_mapped"]:
        say(f"[!] {r['unmapped_total']} unmapped code(s) preserved and flagged")
    return 0


def _glyphs(spark: SparkSession, path: str, numbers: list[int] | None, recursive: bool) -> tuple[DataFrame, DataFrame]:
    if path.endswith(".jsonl"):
        g, sizes = layout.read(spark, path, recursive)
        return tuple(x if numbers is None else x.where(F.col("page_no").isin(numbers)) for x in (g, sizes))
    trees = list(pdf.pages(path, 0, numbers, recursive))
    rows = [r for t in trees for r in layout.glyphs_of(t, recursive)]
    return spark.createDataFrame(rows, layout.GLYPHS), spark.createDataFrame([(0, t["page_no"], float(t["width"]), float(t["height"])) for t in trees], layout.SIZES)


def _layers(spark: SparkSession, a: argparse.Namespace, numbers: list[int] | None) -> int:
    g, sizes = _glyphs(spark, a.pdf, numbers, True)
    bands = layers.classify(g, sizes).persist()
    notes = {r["page_no"]: r for r in sinks.page_warnings(bands, sizes).orderBy("page_no").collect()}
    form = sinks.page_markdown(bands).withColumnRenamed("markdown", "out") if a.md else sinks.layer_text(bands, a.layer).withColumnRenamed("text", "out") if a.layer else sinks.page_json(bands, sizes).withColumnRenamed("json", "out")
    made = {r["page_no"]: r["out"] for r in form.collect() if r["out"]}
    for n, r in notes.items():
        if r["blank"] and not a.layers:
            say(f"[!] page {n}: {sinks.BLANK_PAGE}")
        if r["raw_cids"]:
            say(f"[!] page {n}: {sinks.RAW_CIDS}")
        if n in made:
            print(made[n])
    if not notes:
        say("error: no such page in this PDF (indices are 0-based; use --list-fonts to probe the file)")
    elif not made:
        say("error: requested layer/pages produced no text (see warnings above)")
    return 0 if made else 1


def _pages(spark: SparkSession, a: argparse.Namespace, numbers: list[int] | None) -> int:
    g, _ = _glyphs(spark, a.pdf, numbers, False)
    toks = sinks.decode_pages(fonts.runs(layout.run_glyphs(g))).persist()
    form = sinks.page_tokens_json(toks).withColumnRenamed("json", "out") if a.json else sinks.page_text(toks).withColumnRenamed("text", "out")
    out = form.orderBy("page_no").collect()
    flagged = {r["page_no"]: r for r in sinks.token_warnings(toks).collect()} if not a.json else {}
    for r in out:
        print(r["out"])
        if f := flagged.get(r["page_no"]):
            say(f"[!] {f['n']} token(s) contain unmapped codes: " + ", ".join(map(repr, f["first"])))
    if not out:
        say("no known legacy Greek font content found")
    return 0 if out else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    if a.list_encodings:
        for e in sorted(ENCODINGS, key=lambda e: e.table_id):
            print(f"{e.table_id}\t{e.font}")
        return 0
    if a.text is None and not a.stdin and a.pdf is None:
        arguments().error("a PDF path is required unless --text/--stdin/--list-encodings is used")
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.text is not None or a.stdin:
        return _text(spark, a.text if a.text is not None else sys.stdin.read(), a.encoding, a.json)
    numbers = None if a.page is None else [a.page]
    if a.list_fonts:
        g, _ = _glyphs(spark, a.pdf, list(range(CENSUS_PAGES)), False)
        for r in fonts.fonts_by_count(fonts.census(fonts.runs(layout.run_glyphs(g)), CENSUS_PAGES)).collect():
            print(f"{r['font']}\t{r['n_chars']} chars")
        return 0
    return _layers(spark, a, numbers) if a.layers or a.layer or a.md else _pages(spark, a, numbers)


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """`main`, with errors as messages."""
    try:
        return main(argv, spark)
    except FileNotFoundError as e:
        say(f"error: file not found: {e.filename or e}")
    except (ValueError, KeyError) as e:
        say(f"error: {e}")
    except Exception as e:
        say(f"error: {type(e).__name__}: {e}")
    return 2


if __name__ == "__main__":
    raise SystemExit(run())
