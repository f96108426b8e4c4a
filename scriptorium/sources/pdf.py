"""A data source of the glyphs of PDF files, through pdfminer.six where that is installed.

    spark.dataSource.register(pdf.GlyphSource)
    spark.read.format("pdf_glyphs").option("paths", "a.pdf,b.pdf").option("pages", "0,3").load()

Every file is a partition; its number in `paths` is its doc_id. The option `mode` is `layout`
(all lines, wherever they sit) or `runs` (those of a page's own boxes, without inferred spaces).
Pages are read in document order, each once, whatever the order in which they are asked for."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import layout


def tree(node, doc_id: int | None = None, page_no: int | None = None) -> dict:
    """A pdfminer layout object as a layout tree."""
    from pdfminer import layout as pm

    if isinstance(node, pm.LTChar):
        box = {c: getattr(node, c) for c in ("x0", "x1", "y0", "y1", "size")}
        return {"type": "char", "text": node.get_text(), "font": node.fontname, "skew": node.matrix[1], **box}
    if isinstance(node, pm.LTAnno):
        return {"type": "anno", "text": node.get_text()}
    kind = "line" if isinstance(node, pm.LTTextLine) else "box" if isinstance(node, pm.LTTextContainer) else "figure"
    out = {"type": kind, "objs": [tree(x) for x in getattr(node, "_objs", None) or []]}
    return out if doc_id is None else out | {"doc_id": doc_id, "page_no": page_no, "width": node.width, "height": node.height}


def pages(path: str, doc_id: int = 0, numbers: list[int] | None = None, all_texts: bool = True) -> Iterator[dict]:
    """Layout trees of a file's pages, with their own numbers."""
    try:
        from pdfminer.high_level import extract_pages
        from pdfminer.layout import LAParams
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pdfminer.six") from e
    wanted = None if numbers is None else sorted(set(numbers))
    for i, page in enumerate(extract_pages(path, page_numbers=wanted, laparams=LAParams(all_texts=all_texts))):
        yield tree(page, doc_id, i if wanted is None else wanted[i])


class _File(InputPartition):
    def __init__(self, path: str, doc_id: int):
        super().__init__(doc_id)
        self.path, self.doc_id = path, doc_id


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.numbers = [int(n) for n in options["pages"].split(",")] if options.get("pages") else None
        self.recursive = options.get("mode", "layout") == "layout"

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(self.paths)]

    def read(self, partition: _File):
        for page in pages(partition.path, partition.doc_id, self.numbers, self.recursive):
            yield from layout.glyphs_of(page, self.recursive)


class GlyphSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_glyphs"

    def schema(self) -> str:
        return layout.GLYPHS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
