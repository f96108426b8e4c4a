"""Key tables of nine pre-Unicode Greek fonts, as plain data and as DataFrames.

Facts about fonts, from public tables under the MIT licence; see README. Each table maps a
character to a letter or to a code: combining marks, a literal, a letter at the end of a word,
and marks that are punctuation or an apostrophe there."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Combining marks.
SMOOTH, ROUGH, ACUTE, GRAVE, CIRC, DIAER, IOTA, MACRON = "\u0313", "\u0314", "\u0301", "\u0300", "\u0342", "\u0308", "\u0345", "\u0304"
VOWELS = "αεηιουω"
# Keys of letters, small then capital, and the letters they stand for.
LATIN, GREEK = "abgdezhqiklmnxoprstufcyw", "αβγδεζηθικλμνξοπρστυφχψω"
LATIN_UP, GREEK_UP = LATIN.upper(), GREEK.upper()
# Marks of the Graeca family, in the order in which they are typed.
GRAECA_MARKS = {
    "j": SMOOTH, "J": ROUGH, "v": ACUTE, ";": GRAVE, "'": CIRC, "\\": SMOOTH + CIRC, "|": ROUGH + CIRC, "[": SMOOTH + ACUTE,
    "]": SMOOTH + GRAVE, "{": ROUGH + ACUTE, "}": ROUGH + GRAVE, "/": IOTA, ">": DIAER,
}
# Confidence by key.
SURE = {c: 0.99 for c in "\"ACDEHIKMOPSTabcdefghiklmnopqrstuwxyz!'/;J[\\]jv{|}"}
GRAECA_SURE = SURE | {c: 0.95 for c in "BFGLNRUW->"} | {c: 0.85 for c in "QZ`"} | {c: 0.7 for c in "XY"}
DEFAULT_CONFIDENCE = 0.9


@dataclass
class Encoding:
    table_id: str
    font: str
    prefixes: tuple[str, ...]
    letters: dict[str, str]
    marks: dict[str, str]
    literals: dict[str, str]
    separators: str
    confidence: dict[str, float] = field(default_factory=dict)
    final_letter: dict[str, str] = field(default_factory=dict)
    final_punct: dict[str, str] = field(default_factory=dict)
    final_apostrophe: str = ""
    cid: bool = False
    accent_fonts: tuple[str, ...] = ()
    accent_offset: int = 0xE000

    def keys(self) -> str:
        return "".join([*self.letters, *self.marks, *(c for c in self.literals if c not in self.marks), *self.final_letter])


def _letters(extra: dict[str, str], keys: str = LATIN + LATIN_UP, values: str = GREEK + GREEK_UP) -> dict[str, str]:
    return dict(zip(keys, values, strict=True)) | extra


# Letters of the four fonts that do not share the keys above.
TIMESGREEK_LETTERS = {
    "a": "α", "b": "β", "g": "γ", "d": "δ", "e": "ε", "j": "η", "q": "θ", "i": "ι", "k": "κ", "l": "λ", "m": "μ", "n": "ν", "z": "ξ", "o": "ο", "p": "π", "r": "ρ",
    "s": "σ", "t": "τ", "u": "υ", "f": "φ", "x": "χ", "y": "ψ", "w": "ω", "v": "ς", "c": "ζ", "A": "Α", "B": "Β", "G": "Γ", "D": "Δ", "E": "Ε", "J": "Η", "Q": "Θ",
    "I": "Ι", "K": "Κ", "L": "Λ", "M": "Μ", "N": "Ν", "Z": "Ξ", "O": "Ο", "P": "Π", "R": "Ρ", "S": "Σ", "T": "Τ", "U": "Υ", "F": "Φ", "X": "Χ", "Y": "Ψ", "W": "Ω",
    "V": "Σ", "C": "Ζ", "h": "ζ", "É": "ώ", "ß": "ή", "á": "ά", "é": "έ", "ê": "ἐ", "í": "ί", "ó": "ό", "ú": "ύ", "¬": "ῶ", "±": "ῆ", "ò": "ὸ", "à": "ὰ", "ä": "ἁ",
    "ì": "ὶ", "û": "ὐ", "â": "ἀ", "⁄": "ῖ", "º": "ὅ", "Õ": "ῦ", "î": "ἰ", "™": "ἡ", "¢": "ᾶ", "ü": "ὑ", "÷": "ἴ", "∫": "ὄ", "À": "ὕ", "¿": "ὥ", "è": "ὲ", "Ü": "ὡ",
    "ë": "ἑ",
}
GRECMONOTYPE_LETTERS = {
    "a": "α", "b": "β", "g": "γ", "d": "δ", "e": "ε", "z": "ζ", "h": "η", "q": "θ", "i": "ι", "k": "κ", "l": "λ", "m": "μ", "n": "ν", "x": "ξ", "o": "ο", "p": "π",
    "r": "ρ", "s": "σ", "t": "τ", "u": "υ", "f": "φ", "c": "χ", "y": "ψ", "w": "ω", "A": "Α", "B": "Β", "G": "Γ", "D": "Δ", "E": "Ε", "Z": "Ζ", "H": "Η", "Q": "Θ",
    "I": "Ι", "K": "Κ", "L": "Λ", "M": "Μ", "N": "Ν", "X": "Ξ", "O": "Ο", "P": "Π", "R": "Ρ", "S": "Σ", "T": "Τ", "U": "Υ", "F": "Φ", "C": "Χ", "Y": "Ψ", "W": "Ω",
    "V": "ς", "\ue040": "έ", "\ue061": "ὶ", "\ue043": "ἐ", "\ue030": "ά", "\ue062": "ῖ", "\ue031": "ὰ", "\ue071": "ὸ", "\ue033": "ἀ", "\ue041": "ὲ", "\ue054": "ἡ", "\ue0a2": "ῦ", "\ue0a3": "ὐ", "\ue070": "ό", "\ue051": "ὴ", "\ue0b2": "ῶ",
    "\ue052": "ῆ", "\ue045": "ἔ", "\ue077": "ὅ", "\ue035": "ἄ", "\ue0b0": "ώ", "\ue050": "ή", "\ue032": "ᾶ", "\ue065": "ἴ", "\ue0a9": "ὖ", "\ue047": "ἕ", "\ue069": "ἶ", "\ue075": "ὄ", "\ue0b4": "ὡ", "\ue067": "ἵ", "\ue06a": "ἷ", "\ue0b7": "ὥ",
    "\ue0a5": "ὔ", "\ue064": "ἱ", "\ue063": "ἰ", "\ue074": "ὁ", "\ue044": "ἑ", "\ue0a4": "ὑ", "\ue073": "ὀ", "\ue053": "ἠ", "\ue0c3": "ῃ", "\ue0cc": "ῇ", "\ue0a1": "ὺ", "\ue036": "ἂ", "\ue056": "ἢ",
}
SPIONIC_CID_LETTERS = {
    "C": "α", "#": "Α", "D": "β", "$": "Β", "I": "γ", ")": "Γ", "F": "δ", "&": "Δ", "G": "ε", "'": "Ε", "\\": "ζ", "<": "Ζ", "J": "η", "*": "Η", "S": "θ", "3": "Θ",
    "K": "ι", "+": "Ι", "M": "κ", "-": "Κ", "N": "λ", ".": "Λ", "O": "μ", "/": "Μ", "P": "ν", "0": "Ν", "E": "ξ", "%": "Ξ", "Q": "ο", "1": "Ο", "R": "π", "2": "Π",
    "T": "ρ", "4": "Ρ", "U": "σ", "5": "Σ", "L": "ς", ",": "Σ", "V": "τ", "6": "Τ", "W": "υ", "7": "Υ", "H": "φ", "(": "Φ", "Z": "χ", ":": "Χ", "[": "ψ", ";": "Ψ",
    "Y": "ω", "9": "Ω",
}
SPIONIC_ASCII_LETTERS = {
    "a": "α", "b": "β", "g": "γ", "d": "δ", "e": "ε", "z": "ζ", "h": "η", "q": "θ", "i": "ι", "k": "κ", "l": "λ", "m": "μ", "n": "ν", "c": "ξ", "o": "ο", "p": "π",
    "r": "ρ", "s": "σ", "j": "ς", "t": "τ", "u": "υ", "f": "φ", "x": "χ", "y": "ψ", "w": "ω", "A": "Α", "B": "Β", "G": "Γ", "D": "Δ", "E": "Ε", "Z": "Ζ", "H": "Η",
    "Q": "Θ", "I": "Ι", "K": "Κ", "L": "Λ", "M": "Μ", "N": "Ν", "C": "Ξ", "O": "Ο", "P": "Π", "R": "Ρ", "S": "Σ", "T": "Τ", "U": "Υ", "F": "Φ", "X": "Χ", "Y": "Ψ",
    "W": "Ω",
}
# The nine tables, in the order that breaks ties.
ENCODINGS = [
    Encoding("graeca", "Graeca", ("Graeca",), _letters({'"': "ς"}), GRAECA_MARKS | {"`": DIAER + GRAVE, "?": DIAER + ACUTE}, {"!": "’", "_": ";"}, ".,:()", GRAECA_SURE | {"?": 0.97}),
    Encoding("graeca2", "GraecaII", ("GraecaII",), _letters({'"': "ς"}), GRAECA_MARKS | {"`": CIRC}, {"!": "’", "_": ";"}, ".,:()", GRAECA_SURE),
    Encoding("odyssea", "Odyssea", ("Odyssea",), _letters({"ı": "ς"}), GRAECA_MARKS | {"`": CIRC}, {"!": "’", "∆": "’"}, ".,:()", GRAECA_SURE, final_letter={'"': "ς"}),
    Encoding("symbolgreek2", "SymbolGreekII", ("SymbolGreekII", "SymbolGreek"), _letters({'"': "ς", "~": "ς"}), GRAECA_MARKS | {"`": CIRC}, {"!": "’"}, ".,:()", GRAECA_SURE),
    Encoding(
        "bwgrkl", "Bwgrkl", ("Bwgrkl",), _letters({"j": "ς"}),
        {",": ACUTE, ".": GRAVE, "/": CIRC, "v": SMOOTH, "V": SMOOTH, "`": ROUGH, ";": SMOOTH + ACUTE, "'": SMOOTH + GRAVE, "=": SMOOTH + CIRC, "|": IOTA, "+": DIAER},
        {"\\": "·", "Å": "."}, '()[]{}<>:!"*', final_punct={",": ",", ".": "."}, final_apostrophe="vV",
    ),
    Encoding(
        "timesgreek", "TimesGreek", ("TimesGreek",), TIMESGREEK_LETTERS,
        {"ç": IOTA, "ˆ": SMOOTH}, {"’": "’"}, ".,;:()!",
    ),
    Encoding(
        "grecmonotype", "GrecMonotype", ("GrecMonotype", "GrecAcc"), GRECMONOTYPE_LETTERS,
        {"\ue042": SMOOTH}, {"’": "’", "'": "’", "-": "-", "\ue0c5": "’"}, ".,:()[]!;", final_apostrophe="\ue042", accent_fonts=("GrecAcc",),
    ),
    Encoding(
        "spionic-cid", "SPIonic", ("SPIonic",), SPIONIC_CID_LETTERS,
        {"\x12": ACUTE, "\x13": SMOOTH, ">": GRAVE, "`": CIRC, "^": CIRC + IOTA, "\x1f": CIRC, "\x0c": SMOOTH, "A": GRAVE, "\x0b": ROUGH, "\x14": SMOOTH + ACUTE}, {},
        "\x01\x02\x03\x04\x0e\x0f\x10\x11\x1b\x1c\x1d\x1e\x7f", cid=True,
    ),
    Encoding(
        "spionic-ascii", "SPIonic (ASCII text keys)", (), SPIONIC_ASCII_LETTERS,
        {"0": SMOOTH, ")": SMOOTH, "9": ROUGH, "(": ROUGH, "/": ACUTE, "&": ACUTE, "\\": GRAVE, "_": GRAVE, "=": CIRC, "~": CIRC, "|": IOTA, "+": DIAER, '"': DIAER,
         "1": SMOOTH + ACUTE, "!": SMOOTH + ACUTE, "2": SMOOTH + GRAVE, "@": SMOOTH + GRAVE, "]": SMOOTH + CIRC, "}": SMOOTH + CIRC, "3": ROUGH + ACUTE, "#": ROUGH + ACUTE,
         "4": ROUGH + GRAVE, "$": ROUGH + GRAVE, "[": ROUGH + CIRC, "{": ROUGH + CIRC, "5": DIAER + ACUTE, "%": DIAER + ACUTE, "6": DIAER + GRAVE, "^": DIAER + GRAVE, "<": MACRON, ">": MACRON},
        {";": ";", ":": "·", "'": "’", "-": "-"}, ".,7",
    ),
]
BY_ID = {e.table_id: e for e in ENCODINGS}
KEYMAP_SCHEMA = "table_id string, ch string, kind string, out string, marks string, final_punct string, final_apostrophe boolean, vowel boolean, rho boolean, breathing boolean, accent boolean, conf double"


def _base(letter: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFD", letter)[:1].lower()


def keymap_rows() -> list[tuple]:
    """One row for each key of each table; kind is letter, mark, literal or final_letter."""
    rows = []
    for e in ENCODINGS:
        def add(ch, kind, out=None, marks=None, e=e):
            vowel, rho = (_base(out) in VOWELS, _base(out) == "ρ") if kind in ("letter", "final_letter") else (False, False)
            rows.append((e.table_id, ch, kind, out, marks, e.final_punct.get(ch), ch in e.final_apostrophe, vowel, rho,
                         bool(marks) and set(marks) <= {SMOOTH, ROUGH}, bool(marks) and bool(set(marks) & {ACUTE, GRAVE, CIRC}), e.confidence.get(ch, DEFAULT_CONFIDENCE)))
        for ch, out in e.letters.items():
            add(ch, "letter", out)
        for ch, marks in e.marks.items():
            add(ch, "mark", None, marks)
        for ch, out in e.literals.items():
            add(ch, "literal", out)
        for ch, out in e.final_letter.items():
            add(ch, "final_letter", out)
    return rows


def keymap(spark: SparkSession) -> DataFrame:
    """The keys of all tables: a fixed number of rows, small enough to broadcast."""
    return spark.createDataFrame(keymap_rows(), KEYMAP_SCHEMA)


def encodings(spark: SparkSession) -> DataFrame:
    rows = [(i, e.table_id, e.font, e.separators, e.cid, len(e.letters), len(e.marks) + len(e.literals) + len(e.final_letter)) for i, e in enumerate(ENCODINGS)]
    return spark.createDataFrame(rows, "reg_order int, table_id string, font string, separators string, cid boolean, n_letters int, n_codes int")


def font_prefixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e.table_id, p, i) for i, e in enumerate(ENCODINGS) for p in e.prefixes], "table_id string, prefix string, reg_order int")
