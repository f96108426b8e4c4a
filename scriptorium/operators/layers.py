"""From glyphs to physical lines, and from lines to the layers of a page.

Glyphs are doc_id, page_no, box_no, line_no, glyph_no, kind ('char', or 'anno' for an inferred
space without geometry), text, font, size, x0, x1, y0, y1, skew; page sizes are doc_id, page_no,
width, height. Coordinates are points, y grows upward. A page is the unit of every exchange, so
one exchange by (doc_id, page_no) serves the folds and windows after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .decode import decode_tokens, nfc
from .fonts import pitch, table_of

PAGE = ["doc_id", "page_no"]
BLANK = T.SPACE + r"\x0B\f\x1C-\x1F\x{0085}\x{1680}\x{2028}\x{2029}"
#: Confidence of each layer.
CONFIDENCE = {"page_number": 0.95, "running_head": 0.9, "heading": 0.85, "greek_text": 0.9, "translation": 0.9, "apparatus": 0.9, "notes": 0.9}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: i["text"]), "")


def modal(values: Column) -> Column:
    """The commonest value of an array; ties go to the one seen first."""
    ranked = F.transform(F.array_distinct(values), lambda v, i: F.struct(F.size(F.filter(values, lambda w: w == v)).alias("n"), (-i).alias("first"), v.alias("v")))
    return F.array_max(ranked)["v"]


def chars(items: Column) -> Column:
    return F.filter(items, lambda i: i["kind"] == "char")


def sizes(items: Column) -> Column:
    return F.transform(chars(items), lambda i: F.bround(i["size"], 1))


def fragments(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Text lines as the layout found them, without rotated text, crop marks and gutter counters.

    folio marks a short number centred at the foot, which is not to be joined with anything."""
    item = F.struct("glyph_no", "kind", "text", "font", "size", "x0", "x1", "y0", "y1")
    f = glyphs.groupBy(*PAGE, "box_no", "line_no").agg(
        F.array_sort(F.collect_list(item)).alias("items"), *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")),
        F.every((F.abs("skew") > 0.01) | (F.col("kind") != "char")).alias("rotated"),
    )
    f = f.withColumn("txt", strip(joined(F.col("items")))).where("x0 is not null and txt <> '' and not coalesce(rotated, false)")
    f = f.join(pages.select(*PAGE, "width", "height"), PAGE, "left")
    edge = (F.col("x1") < 72) | F.coalesce(F.col("x0") > F.col("width") - 72, F.lit(False))
    crop = F.col("txt").rlike(r"^\p{L}{1,2}$") & edge & F.coalesce((F.col("y0") < 40) | (F.col("y0") > F.col("height") - 40), F.lit(False))
    number = F.col("txt").rlike(r"^\p{Nd}{1,4}$")
    folio = number & F.coalesce((F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("width") / 2) < 40) & (F.col("y0") < 0.15 * F.col("height")), F.lit(False))
    gutter = number & (F.col("x1") - F.col("x0") < 25) & F.coalesce(F.col("x1") < 0.22 * F.col("width"), F.lit(False))
    f = f.withColumn("folio", folio).where(~crop & (F.col("folio") | ~gutter))
    return f.select(*PAGE, "box_no", "line_no", "folio", "x0", "x1", "y0", "y1", modal(sizes(F.col("items"))).alias("size"), "items", "height")


def _group_numbers(frs: Column) -> Column:
    """Physical line of each of a page's ordered fragments: one joins the line before it if it overlaps
    more than half of the lower one's height and starts within three times the larger size."""
    start = F.struct(F.array().cast("array<int>").alias("ids"), *(F.lit(None).cast("double").alias(c) for c in ("y0", "y1", "x1", "size")))

    def step(a: Column, f: Column) -> Column:
        span = F.least(a["y1"] - a["y0"], f["y1"] - f["y0"])
        overlap = F.least(a["y1"], f["y1"]) - F.greatest(a["y0"], f["y0"])
        near = (span > 0) & (overlap > 0.5 * span) & (f["x0"] - a["x1"] < 3 * F.greatest(f["size"], a["size"]))
        joins = F.coalesce(near, F.lit(False)) & ~f["folio"]
        at = F.coalesce(F.try_element_at(a["ids"], F.lit(-1)), F.lit(-1)) + F.when(joins, 0).otherwise(1)
        keep = lambda c, both: F.when(joins, both(a[c], f[c])).otherwise(f[c]).alias(c)
        return F.struct(F.concat(a["ids"], F.array(at)).alias("ids"), keep("y0", F.least), keep("y1", F.greatest), keep("x1", F.greatest), keep("size", lambda x, _: x))

    return F.aggregate(frs, start, step, lambda a: a["ids"])


def _merge_glyphs(items: Column) -> Column:
    """Glyphs of several fragments as one line: overlaid copies go, wide gaps become one or two spaces."""
    glyph = lambda i, text, kind: F.struct(F.lit(kind).alias("kind"), text.alias("text"), *(i[c].alias(c) for c in ("font", "size", "x0", "x1", "y0")))
    order = F.array_sort(F.transform(chars(items), lambda i: F.struct(i["x0"].alias("x0"), (-i["y0"]).alias("down"), i.alias("i"))))
    ordered = F.transform(order, lambda o: glyph(o["i"], o["i"]["text"], "char"))

    def step(acc: Column, c: Column) -> Column:
        recent = F.slice(acc, F.greatest(F.size(acc) - 3, F.lit(1)), 4)
        copy = F.exists(recent, lambda p: (p["kind"] == "char") & (p["text"] == c["text"]) & (c["x0"] - p["x0"] <= 0.15 * F.greatest(c["size"], F.lit(1.0))) & (F.abs(c["y0"] - p["y0"]) < 1.5))
        last = F.try_element_at(acc, F.lit(-1))
        gap = (c["x0"] - last["x1"]) / F.greatest(last["size"], c["size"], F.lit(1.0))
        space = F.when(gap > 1.2, F.array(glyph(c, F.lit("  "), "anno"))).when(gap > 0.18, F.array(glyph(c, F.lit(" "), "anno"))).otherwise(F.slice(acc, 1, 0))
        return F.when(copy, acc).otherwise(F.concat(acc, space, F.array(c)))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def physical_lines(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, text, x0, x1, y0, y1, size, fonts, height, items; folios last on their page.

    size is the commonest, fonts has the font of every glyph; items are the glyphs with spaces."""
    f = fragments(glyphs, pages)
    row = F.struct("folio", (-F.col("y0")).alias("down"), "x0", "box_no", "line_no", "x1", "y0", "y1", "size", "items", "height")
    p = f.groupBy(*PAGE).agg(F.array_sort(F.collect_list(row)).alias("frs"))
    p = p.select(*PAGE, "frs", _group_numbers(F.transform("frs", lambda r: F.struct(*(r[c].alias(c) for c in ("folio", "x0", "x1", "y0", "y1", "size"))))).alias("ids"))
    box = [F.min(c).alias(c) for c in ("x0", "y0")] + [F.max(c).alias(c) for c in ("x1", "y1", "height")]
    g = p.select(*PAGE, F.posexplode(F.arrays_zip("ids", "frs")).alias("k", "z")).select(
        *PAGE, "k", F.col("z.ids").alias("line_no"), *(F.col(f"z.frs.{c}").alias(c) for c in ("x0", "x1", "y0", "y1", "height", "items"))
    )
    g = g.groupBy(*PAGE, "line_no").agg(*box, F.transform(F.array_sort(F.collect_list(F.struct("k", "items"))), lambda x: x["items"]).alias("parts"))
    plain = F.transform(F.col("parts")[0], lambda i: F.struct(*(i[c].alias(c) for c in ("kind", "text", "font", "size", "x0", "x1", "y0"))))
    g = g.withColumn("items", F.when(F.size("parts") > 1, _merge_glyphs(F.flatten("parts"))).otherwise(plain)).withColumn("text", strip(joined(F.col("items"))))
    fonts = F.transform(chars(F.col("items")), lambda i: F.element_at(F.split(i["font"], r"\+"), -1))
    return g.where("text <> ''").select(*PAGE, "line_no", "text", "x0", "x1", "y0", "y1", modal(sizes(F.col("items"))).alias("size"), fonts.alias("fonts"), "height", "items")


def decode_lines(lines: DataFrame) -> DataFrame:
    """`lines` with decoded and greek_ratio: runs in legacy fonts decoded chunk by chunk, spaces and the rest as they are."""
    line = [*PAGE, "line_no"]
    w = Window.partitionBy(*line).orderBy("i")
    g = lines.select(*line, F.posexplode("items").alias("i", "g")).select(*line, "i", "g.text", F.when(F.col("g.kind") == "char", F.col("g.font")).alias("font"))
    g = g.withColumn("font", F.last("font", ignorenulls=True).over(w))
    g = g.withColumn("run", F.sum(F.when(F.col("font").eqNullSafe(F.lag("font").over(w)), 0).otherwise(1)).over(w))
    runs = g.groupBy(*line, "run", "font").agg(joined(F.array_sort(F.collect_list(F.struct("i", "text")))).alias("text"))
    c = runs.select(*line, "run", "font", F.posexplode(F.regexp_extract_all("text", F.lit(f"[{BLANK}]+|[^{BLANK}]+"), F.lit(0))).alias("c", "token"))
    c = c.withColumn("table_id", table_of(F.col("font")))
    legacy = F.col("table_id").isNotNull() & ~F.col("token").rlike(f"^[{BLANK}]")
    done = decode_tokens(c.where(legacy), passthrough=False).select(*line, "run", "c", "text")
    parts = done.union(c.where(~legacy).select(*line, "run", "c", F.col("token").alias("text")))
    text = nfc(joined(F.array_sort(F.collect_list(F.struct("run", "c", "text")))))
    decoded = parts.groupBy(*line).agg(text.alias("decoded")).withColumn("decoded", strip(F.col("decoded")))
    out = lines.drop("items").join(decoded, line, "left").withColumn("decoded", F.coalesce("decoded", F.lit("")))
    greek, letters = F.length(F.regexp_replace("decoded", f"[^{T.GREEK}]", "")), F.length(F.regexp_replace("decoded", r"[^\p{L}]", ""))
    return out.withColumn("greek_ratio", greek / F.greatest(letters, F.lit(1)))


def _furniture(lines: DataFrame) -> DataFrame:
    """`lines` with pitch and layer: page_number, running_head or null."""
    by, page = Window.partitionBy(*PAGE).orderBy("line_no"), Window.partitionBy(*PAGE)
    d = lines.join(pitch(lines), PAGE).withColumn("rn", F.row_number().over(by)).withColumn("n", F.count("*").over(page))
    digits = T.digits_only(F.col("text"))
    bottom = (F.col("rn") == F.col("n")) & digits & F.coalesce(F.lag("y0").over(by) - F.col("y0") > 1.6 * F.col("pitch"), F.lit(False))
    d = d.withColumn("bottom", bottom)
    header = ~F.max("bottom").over(page) & (F.col("rn") <= 3) & (F.col("rn") < F.col("n")) & digits & (F.length("text") <= 6) & F.coalesce(F.col("y0") > 0.85 * F.col("height"), F.lit(False))
    d = d.withColumn("header", header)
    d = d.withColumn("folio", F.col("bottom") | (F.col("header") & (F.col("rn") == F.min(F.when(F.col("header"), F.col("rn"))).over(page))))
    rest = Window.partitionBy(*PAGE, "folio").orderBy("line_no")
    top = ~F.col("folio") & (F.row_number().over(rest) == 1) & F.coalesce(F.col("y0") - F.lead("y0").over(rest) > 1.6 * F.col("pitch"), F.lit(False))
    head = top & (F.length("text") < 70) & ~F.col("text").rlike("[.;·!?]$")
    evidence = F.when(F.col("bottom"), "digits-only bottom line, isolated by >1.6x pitch").when(F.col("folio"), "digits-only header line, short, in the top page band").when(F.col("head"), "top line isolated by >1.6x pitch, short")
    d = d.withColumn("head", head).withColumn("evidence", evidence)
    return d.withColumn("layer", F.when(F.col("folio"), "page_number").when(F.col("head"), "running_head")).drop("rn", "n", "bottom", "header", "folio", "head")


def _split(body: DataFrame) -> DataFrame:
    """`body` with idx and foot: whether a line stands below the boundary of text and notes."""
    by, page = Window.partitionBy(*PAGE).orderBy("line_no"), Window.partitionBy(*PAGE)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    b = body.withColumn("idx", F.row_number().over(by) - 1).withColumn("mark", (F.length("text") <= 12) & (F.col("x1") - F.col("x0") < 40))
    seen = lambda c: F.coalesce(F.last(F.when(~F.col("mark"), F.col(c)), ignorenulls=True).over(before), F.first(c).over(before))
    content = ~F.col("mark") & ~F.col("text").rlike(r"^\p{Nd}{1,4}$")
    b = b.withColumn("gap", seen("y0") - F.col("y0")).withColumn("size_above", seen("size"))
    b = b.withColumn("upper", modal(F.collect_list("size").over(before))).withColumn("below", F.collect_list(F.when(content, F.col("size"))).over(after))
    b = b.withColumn("n", F.size("below")).withColumn("dropped", F.size(F.filter("below", lambda s: s < F.col("upper") - 0.5))).drop("below")
    drop = F.col("upper") - F.col("size")
    candidate = ~F.col("mark") & (F.col("gap") > 0.85 * F.col("pitch")) & (F.col("n") > 0) & (drop > 0.5) & (F.col("dropped") >= 0.7 * F.col("n"))
    edge = F.abs(F.col("size_above") - F.col("upper")) < 0.5
    full = (F.col("dropped") >= 0.9 * F.col("n")) & ((F.col("idx") >= 4) | (F.col("upper") <= 11)) & edge
    wide = F.col("gap") > 1.7 * F.col("pitch")
    soft = (F.col("gap") > 1.15 * F.col("pitch")) & (F.col("n") >= 3)
    sharp = (F.col("n") >= 2) & (F.col("dropped") == F.col("n"))
    strong = F.when(wide, F.col("n") >= 3).otherwise(edge & (drop >= 1.5) & (soft | sharp | ((F.col("n") >= 5) & full)))
    b = b.withColumn("strong", F.coalesce(candidate & strong, F.lit(False))).withColumn("full", F.coalesce(full, F.lit(False))).withColumn("small", F.coalesce(candidate & wide & (F.col("n") < 3), F.lit(False)))
    widest = F.max_by("idx", F.when(F.col("strong") & F.col("full"), F.struct("gap", -F.col("idx")))).over(page)
    last = lambda c: F.max(F.when(F.col(c), F.col("idx"))).over(page)
    b = b.withColumn("split", F.coalesce(widest, last("strong"), last("small")))
    return b.withColumn("foot", F.coalesce(F.col("idx") >= F.col("split"), F.lit(False))).drop("mark", "gap", "size_above", "upper", "n", "dropped", "strong", "full", "small", "split")


def _short(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def bands(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, band_no, layer, confidence, evidence, inline_refs, bbox, text, n_lines, printed_page of decoded lines.

    Layers: running_head, page_number, heading, greek_text, translation, and apparatus (where the
    page has Greek text) or notes."""
    f = _furniture(lines)
    w = Window.partitionBy(*PAGE, "foot").orderBy("line_no")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = _split(f.where("layer is null"))
    b = b.withColumn("left", F.min("x0").over(whole)).withColumn("right", F.max("x1").over(whole))
    b = b.withColumn("body_size", modal(F.collect_list("size").over(whole))).withColumn("body_font", modal(F.flatten(F.collect_list("fonts").over(whole))))
    slack = 0.12 * (F.col("right") - F.col("left"))
    centred = (F.col("x0") - F.col("left") > slack) & (F.col("right") - F.col("x1") > slack)
    heading = ~F.col("foot") & centred & ((modal(F.col("fonts")) != F.col("body_font")) | (F.col("size") != F.col("body_size"))) & ~T.digits_only(F.col("text"))
    b = b.withColumn("heading", heading)
    b = b.withColumn("seg", F.sum(F.when(F.col("heading") == F.lag("heading").over(w), 0).otherwise(1)).over(w))
    b = b.withColumn("closing", F.col("seg") == F.max("seg").over(whole))
    rank = F.when(F.col("layer") == "running_head", 0).when(F.col("layer") == "page_number", 1).when(F.col("foot"), F.lit(1 << 30)).otherwise(1 + F.col("seg"))
    every = b.unionByName(f.where("layer is not null"), allowMissingColumns=True).withColumn("rank", rank)
    one = F.struct("line_no", "decoded", "text")
    shown = lambda x: F.when(x["decoded"] != "", x["decoded"]).otherwise(x["text"])
    weight = F.greatest(F.length("decoded"), F.lit(1))
    g = every.groupBy(*PAGE, "rank").agg(
        F.first("layer").alias("layer"), F.first("evidence").alias("evidence"), F.first("heading").alias("heading"), F.first("closing").alias("closing"), F.first("foot").alias("foot"), F.max("body_size").alias("body_size"),
        (F.sum(F.col("greek_ratio") * weight) / F.sum(weight) > 0.5).alias("greek"), F.array_sort(F.collect_list(one)).alias("ls"), F.array_sort(F.collect_set("size")).alias("sizes"),
        F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).alias("bbox"),
    )
    page = Window.partitionBy(*PAGE)
    main = F.col("layer").isNull() & ~F.col("foot")
    g = g.withColumn("has_greek", F.coalesce(F.max(main & ~F.col("heading") & F.col("greek")).over(page), F.lit(False)))
    g = g.withColumn("main_size", F.max(F.when(main, F.col("body_size"))).over(page))
    layer = F.coalesce("layer", F.when(F.col("foot"), F.when(F.col("has_greek"), "apparatus").otherwise("notes")).when(F.col("heading"), "heading").when(F.col("greek"), "greek_text").otherwise("translation"))
    in_body = main & ~F.col("heading")
    size = _short(F.col("main_size"))
    script = F.when(F.col("greek"), "Greek-script majority").otherwise("Latin-script majority")
    context = F.when(F.col("has_greek"), "greek_text").otherwise("translation")
    evidence = (
        F.when(F.col("layer").isNotNull(), F.col("evidence"))
        .when(F.col("foot"), F.concat(F.lit("foot band after a >1.7x-pitch gap, size register ["), F.array_join(F.transform("sizes", lambda s: s.cast("string")), ", "), F.lit("] below body "), size, F.lit("pt; page context: "), context))
        .when(F.col("heading") & F.col("closing"), "centered narrow line(s)").when(F.col("heading"), "centered, and typographically distinct from the body (font family or size)")
        .otherwise(F.concat(F.lit("body register "), size, F.lit("pt; "), script))
    )
    refs = F.when(in_body, F.flatten(F.transform("ls", lambda x: T.inline_refs(x["decoded"])))).otherwise(F.array().cast("array<string>"))
    printed = F.max(F.when(F.col("layer") == "page_number", F.col("ls")[0]["text"])).over(page)
    confidence = F.create_map(*(F.lit(v) for kv in CONFIDENCE.items() for v in kv))
    g = g.withColumn("printed_page", printed).withColumn("evidence", evidence).withColumn("inline_refs", refs).withColumn("layer", layer)
    return g.select(
        *PAGE, (F.row_number().over(page.orderBy("rank")) - 1).alias("band_no"), "layer", confidence[F.col("layer")].alias("confidence"), "evidence", "inline_refs", "bbox",
        F.array_join(F.transform("ls", shown), "\n").alias("text"), F.size("ls").alias("n_lines"), "printed_page",
    )


def has_legacy_greek(glyphs: DataFrame) -> DataFrame:
    """doc_id, page_no, has_legacy_greek: whether a page has a glyph in a known legacy font."""
    known = table_of(F.element_at(F.split("font", r"\+"), -1)).isNotNull() & (F.col("kind") == "char")
    return glyphs.groupBy(*PAGE).agg(F.coalesce(F.bool_or(known), F.lit(False)).alias("has_legacy_greek"))


def classify(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    return bands(decode_lines(physical_lines(glyphs, pages)))
