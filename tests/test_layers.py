import pytest

from scriptorium.operators import layers

GREEK, LATIN = "GFDJFH+Graeca", "Garamond"
VERSE = "oiJ fivloi kai; yuchvn ejxei'pen"
PROSE = "the old road winds down among pines to the harbour"
NOTE = "7 yuchvn ] thumon cod. Parmensis, uel animam"
W, H, LEFT = 480.0, 700.0, 60.0
SCHEMA = "doc_id long, page_no int, box_no int, line_no int, glyph_no int, kind string, text string, font string, size double, x0 double, x1 double, y0 double, y1 double, skew double"


def row(text, y, size=10.5, font=LATIN, x=LEFT, skew=0.0):
    return [(text, font)], y, size, x, skew


def stack(n, y, step, text, size, font=LATIN):
    return [row(text, y - step * k, size, font) for k in range(n)]


def greek_page():
    return [row("Of the islands", 640, 9.0, x=190.0), *stack(10, 600, 13, VERSE, 11.0, GREEK), *stack(3, 467, 10, NOTE, 8.5), row("58", 80, x=233.0)]


def translation_page():
    body, second = stack(5, 600, 13, PROSE, 10.5), stack(6, 499, 13, PROSE, 10.5)
    return [row("Of the islands", 640, 9.0, x=190.0), *body, row("The second voyage", 521, 10.5, "Garamond-Italic", 150.0), *second, row("A single note stands here", 404, 8.5), row("59", 80, x=233.0)]


CASES = {
    1: greek_page(),
    2: translation_page(),
    3: [*stack(2, 600, 13, VERSE, 11.0, GREEK), ([("oiJ kai; ", GREEK), ("[p. 112]  ", LATIN), ("fivloi", GREEK)], 574, 11.0, LEFT, 0.0), *stack(3, 561, 13, VERSE, 11.0, GREEK)],
    4: [row(VERSE, 600 - 13 * k, 11.0, GREEK, 150.0 if k == 5 else LEFT) for k in range(9)],
    5: [row("A book of roads", 660, x=150.0), row("31", 659, x=380.0), *stack(8, 590, 13, PROSE, 10.5)],
    6: [row("fivloi", 600, 11.0, GREEK, 95.0), row("oiJ kai;", 600.5, 11.0, GREEK, 45.0)],
    7: [*translation_page(), row("Q", 560, 150.0, skew=0.6)],
    8: [*greek_page(), row("x", 690, x=20.0), row("x", 6, x=20.0), row("Zq", 400, 8.5, x=45.0)],
    9: [*stack(4, 600, 13, PROSE, 10.5), *stack(3, 538.5, 10, "see the map of the coast", 8.5)],
    10: [row("see the map", 100, 8.5), row("9", 94, x=235.0), row("and the index of names", 88, 8.5)],
    11: [row("fivloi kai; yuchvn 4.", 600, 11.0, GREEK), *stack(2, 530, 12, "see the map of the coast", 8.5)],
    12: [row("One line above them all", 640, 11.5), *stack(10, 610, 13, PROSE, 10.5), *stack(5, 453, 10, "see the map of the coast", 8.5)],
    13: [*stack(6, 600, 13, PROSE, 10.5), row(". . . .", 80)],
    14: [*stack(6, 600, 13, PROSE, 10.5), row("15", 561, x=25.0)],
    15: [row(PROSE, 600), row("old road", 600, x=LEFT + 4 * 5.25), *stack(3, 587, 13, PROSE, 10.5)],
    16: [row("first", 600), row("second", 600, x=LEFT + 5 * 5.25 + 6.0), row("third", 600, x=LEFT + 5 * 5.25 + 6.0 + 6 * 5.25 + 20.0)],
}


@pytest.fixture(scope="module")
def glyphs(spark):
    out = []
    for doc, lines in CASES.items():
        for n, (runs, y, size, x, skew) in enumerate(lines):
            k = 0
            for text, font in runs:
                for ch in text:
                    out.append((doc, 0, n, 0, k, "char", ch, font, size, x + k * size / 2, x + (k + 1) * size / 2, float(y), y + size, skew))
                    k += 1
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame([(d, 0, W, H) for d in CASES], "doc_id long, page_no int, width double, height double")


@pytest.fixture(scope="module")
def pages(glyphs, sizes):
    out = {d: [] for d in CASES}
    for r in layers.classify(glyphs, sizes).orderBy("doc_id", "band_no").collect():
        out[r.doc_id].append(r)
    return out


def names(rows):
    return [r.layer for r in rows]


def test_greek_page(pages):
    p = pages[1]
    assert names(p) == ["running_head", "page_number", "greek_text", "apparatus"]
    assert [r.n_lines for r in p] == [1, 1, 10, 3] and {r.printed_page for r in p} == {"58"}
    assert p[2].text.split("\n")[0] == "οἱ φίλοι καὶ ψυχήν ἐξεῖπεν"
    assert ["Parmensis" in r.text for r in p] == [False, False, False, True]


def test_translation_page_with_heading(pages):
    assert names(pages[2]) == ["running_head", "page_number", "translation", "heading", "translation", "notes"]
    assert names(pages[7]) == names(pages[2]) and not any("Q" in r.text for r in pages[7])


def test_inline_reference(pages):
    assert [r.inline_refs for r in pages[3] if r.layer == "greek_text"] == [["[p. 112]"]]


def test_indented_line_is_no_heading(pages):
    assert names(pages[4]) == ["greek_text"] and pages[4][0].n_lines == 9


def test_folios(pages):
    assert pages[5][0].printed_page == "31"
    assert "page_number" not in names(pages[13])


def test_fragments_join_in_order_of_x(pages):
    assert [r.text for r in pages[6]] == ["οἱ καὶ φίλοι"]


def test_crop_marks_and_counters(pages):
    words = "\n".join(r.text for r in pages[8]).split("\n")
    assert "x" not in words and "Zq" in words
    assert "15" not in "\n".join(r.text for r in pages[14]).split("\n")


def test_overlaid_copies_go_and_gaps_become_spaces(glyphs, sizes):
    text = lambda doc: layers.physical_lines(glyphs.where(f"doc_id = {doc}"), sizes).orderBy("line_no").first().text
    assert text(15) == PROSE and text(16) == "first second  third"


def test_foot(pages):
    assert names(pages[9]) == ["translation", "notes"] and pages[9][1].n_lines == 3
    assert "running_head" not in names(pages[11]) and "greek_text" in names(pages[11])
    assert [(r.layer, r.n_lines) for r in pages[12]][-1] == ("notes", 5)


def test_folio_candidates_come_last(glyphs, sizes):
    rows = layers.physical_lines(glyphs.where("doc_id = 10"), sizes).orderBy("line_no").collect()
    assert [r.text for r in rows] == ["see the map", "and the index of names", "9"]


def test_empty(spark, glyphs, sizes):
    assert layers.classify(glyphs.where("false"), sizes).count() == 0
