"""Glyph rows of pages from layout trees.

A tree is a page {doc_id, page_no, width, height, objs}; its nodes are {type, objs} with type box,
figure or line, and a line's are {type: char, text, font, size, x0, x1, y0, y1, skew} or {type:
anno, text} for an inferred space. The layout path takes every line wherever it sits; the run
path only the lines of a page's own boxes, and no inferred spaces.

Defined cases: a page without lines has a size and no glyphs; a missing number is null; a line that
is no valid tree raises; several trees of one page are read one after another."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GLYPHS = "doc_id long, page_no int, box_no int, line_no int, glyph_no int, kind string, text string, font string, size double, x0 double, x1 double, y0 double, y1 double, skew double"
SIZES = "doc_id long, page_no int, width double, height double"
_NUMBERS = ("size", "x0", "x1", "y0", "y1", "skew")


def lines(node: dict) -> Iterator[dict]:
    """Every line below a node, depth first; nothing within a line is one."""
    todo = [node]
    while todo:
        at = todo.pop()
        if at.get("type") == "line":
            yield at
        else:
            todo.extend(reversed(at.get("objs") or []))


def glyphs_of(page: dict, recursive: bool = True) -> Iterator[tuple]:
    """Rows of GLYPHS of one tree."""
    for box_no, box in enumerate(page.get("objs") or []):
        if recursive:
            found = lines(box)
        else:
            found = (x for x in box.get("objs") or [] if x.get("type") == "line") if box.get("type") == "box" else ()
        for line_no, line in enumerate(found):
            for glyph_no, g in enumerate(line.get("objs") or []):
                if g["type"] == "char":
                    yield (page["doc_id"], page["page_no"], box_no, line_no, glyph_no, "char", g["text"], g.get("font") or "", *(None if g.get(c) is None else float(g[c]) for c in _NUMBERS))
                elif recursive:
                    yield (page["doc_id"], page["page_no"], box_no, line_no, glyph_no, "anno", g["text"], *[None] * 7)


def _batches(recursive: bool):
    def run(batches):
        for b in batches:
            for value in b.column("value").to_pylist():
                rows = list(glyphs_of(json.loads(value), recursive)) if value and value.strip() else []
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=[f.split()[0] for f in GLYPHS.split(", ")])

    return run


_TYPES = [pa.int64(), *[pa.int32()] * 4, *[pa.string()] * 3, *[pa.float64()] * 6]


def read(spark: SparkSession, path: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(glyphs, page sizes) of files with one tree a line."""
    text = spark.read.text(path)
    sizes = text.select(F.from_json("value", SIZES).alias("p")).where("p.doc_id is not null").select("p.*").distinct()
    return text.mapInArrow(_batches(recursive), GLYPHS), sizes


def run_glyphs(glyphs: DataFrame) -> DataFrame:
    """Glyphs with their line's number on the page, as `fonts.runs` takes them."""
    number = (F.col("box_no").cast("long") * (1 << 20) + F.col("line_no")).alias("line_no")
    return glyphs.where("kind = 'char'").select("doc_id", "page_no", number, "glyph_no", "font", "text")
