"""Splitting text into lines and legacy tokens, and small character tests; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keytables import BY_ID, Encoding

# Character classes, as regular-expression fragments that Java and RE2 both read.
SPACE = r" \t\n\r\x{00A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}"
SEPARATORS = "«»—–*&%§¶•°€#"
WORD = r"A-Za-z\x{0300}-\x{036F}\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}\x{E000}-\x{F8FF}\-"
GREEK = r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}"
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{0085}\x{2028}\x{2029}]"
INLINE_REF = r"\[(?:fol\.|p\.|col\.|PG|PL)\s?[^\]]{0,30}\]"
DIGITS = r"^[0-9ivxlcIVXLC .\-–]+$"
DIGITS_SOME = r"[0-9ivxlc]"


def char_class(chars: str) -> str:
    """Characters as code points for use inside a class: no character is then special."""
    return "".join(rf"\x{{{ord(c):04X}}}" for c in chars)


def separator_regex(e: Encoding) -> str:
    keys = e.keys()
    digits = "" if any(c.isdigit() for c in keys) else r"\p{Nd}"
    return f"[{SPACE}{digits}{char_class(''.join(c for c in SEPARATORS + e.separators if c not in keys))}]+"


def keep_regex(e: Encoding) -> str:
    return f"[{WORD}{char_class(e.keys())}]"


def lines(text: Column) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    parts = F.split(text, LINE_END)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tokens(line: Column, table_id: str) -> Column:
    """Tokens of one line under a table: split at separators, trimmed of hyphens, with a word character or key."""
    e = BY_ID[table_id]
    trimmed = F.transform(F.split(line, separator_regex(e)), lambda t: F.regexp_replace(t, r"^-+|-+$", ""))
    return F.filter(trimmed, lambda t: t.rlike(keep_regex(e)))


def is_greek(c: Column) -> Column:
    return c.rlike(f"[{GREEK}]")


def greek_letters(c: Column) -> Column:
    """How many letters of a text lie in the Greek blocks."""
    return F.length(F.regexp_replace(c, rf"[^{GREEK}]|[^\p{{L}}]", ""))


def other_letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, rf"[{GREEK}]|[^\p{{L}}]", ""))


def inline_refs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(INLINE_REF), F.lit(0))


def digits_only(c: Column) -> Column:
    """A folio line: digits, roman numerals, stops and dashes, with one digit or small numeral at least."""
    return c.rlike(DIGITS) & c.rlike(DIGITS_SOME)


def final_sigma(word: Column) -> Column:
    return F.regexp_replace(word, "σ(?=[’·.,;·]*$)", "ς")


def repair(lines_: Column, table_id: str) -> Column:
    """Lines with broken words joined and marks that slipped to the next line put back.

    A fold over one document's lines, since a line may change the one before it: hyphens
    around another font's insert go; a leading run of mark codes before a space or the end
    moves to the line before, if that has a word character; a line that ends with a hyphen
    takes the next one in."""
    codes = char_class("".join(BY_ID[table_id].marks))
    run = rf"^([{codes}]+)([{SPACE}]|$)"
    blank = rf"[{SPACE}\x0B\f\x1C-\x1F\x{{0085}}\x{{1680}}\x{{2028}}\x{{2029}}]+"

    def step(acc: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"(?<=[A-Za-z])-[ ]+-(?=[A-Za-z])", "")
        last = F.try_element_at(acc, F.lit(-1))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        moved = F.regexp_extract(line, run, 1)
        moves = (moved != "") & last.isNotNull() & last.rlike(f"[{WORD}]")
        last = F.when(moves, F.concat(F.regexp_replace(last, blank + "$", ""), moved)).otherwise(last)
        rest = F.when(moves, F.regexp_replace(F.substr(line, F.length(moved) + 1), "^" + blank, "")).otherwise(line)
        joined = F.concat(F.regexp_replace(last, "-$", ""), F.regexp_replace(rest, "^-+", ""))
        return (
            F.when(moves & (rest == ""), F.concat(head, F.array(last)))
            .when(last.isNotNull() & last.endswith("-"), F.concat(head, F.array(joined)))
            .when(last.isNotNull(), F.concat(head, F.array(last, rest)))
            .otherwise(F.array(rest))
        )

    return F.aggregate(lines_, F.array().cast("array<string>"), step)


def token_rows(docs: DataFrame, table_id: str, id_col: str = "doc_id", text_col: str = "text", repaired: bool = True) -> DataFrame:
    """id, line_no, tok_no, token of every token of every document."""
    ls = lines(F.coalesce(F.col(text_col), F.lit("")))
    ls = repair(ls, table_id) if repaired else ls
    d = docs.select(id_col, F.posexplode(ls).alias("line_no", "line"))
    return d.select(id_col, "line_no", F.posexplode(tokens(F.col("line"), table_id)).alias("tok_no", "token"))
