"""The decode kernel: many tokens at once, as numpy columns over all their characters.

Every character is an entry of flat arrays, and what a character needs to know about its
neighbours comes from running maxima over them. A mark's carrier is the last vowel letter
before it in its token (rho will do for breathings); without one it waits for the next letter,
and without that it is an orphan at the token's end. Only the last character's special
readings look at the units before it. Unknown characters pass through, flagged.

Python is needed for NFC, which Spark lacks; the rest is here with it so that a document's
tokens cross to Python once and need no shuffle. Nothing grows with the input: what a worker
remembers is bounded."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import numpy as np

from . import text as T
from .keytables import DEFAULT_CONFIDENCE, ENCODINGS, keymap_rows

KINDS = ("unmapped", "letter", "mark", "literal", "final_letter")
LETTER, MARK, LITERAL, FINAL_LETTER = 1, 2, 3, 4
TABLE = {e.table_id: i for i, e in enumerate(ENCODINGS)}
TEXT_TABLES = [i for i, e in enumerate(ENCODINGS) if not e.cid]
BMP = 1 << 16
SIGMA = re.compile("σ(?=[’·.,;·]*$)")
#: A character from here on may combine with the one before it; the tables' own units never do.
COMBINES = 0x300


class _Keys:
    """Columns over all keys of all tables; key 0 stands for an unmapped character."""

    def __init__(self):
        rows = keymap_rows()
        at = {t: i for i, t in enumerate(TABLE)}
        self.index = np.zeros((len(ENCODINGS), BMP), np.int16)
        for k, r in enumerate(rows, 1):
            self.index[at[r[0]], ord(r[1])] = k
        code = lambda s: ord(s) if s else 0
        col = lambda f, empty, dtype: np.array([empty, *map(f, rows)], dtype)
        self.kind = col(lambda r: KINDS.index(r[2]), 0, np.int8)
        self.out = col(lambda r: code(r[3]), 0, np.int64)
        self.marks = col(lambda r: MARKS.of(r[4] or ""), 0, np.int64)
        self.final_punct = col(lambda r: code(r[5]), 0, np.int64)
        self.final_apostrophe = col(lambda r: r[6], False, bool)
        self.vowel, self.rho, self.breathing, self.accent = (col(lambda r, i=i: r[i], False, bool) for i in (7, 8, 9, 10))
        self.conf = col(lambda r: r[11], DEFAULT_CONFIDENCE, np.float64)


class _Marks:
    """Strings of combining marks by number; a token's marks are few, and so are these."""

    def __init__(self):
        self.strings, self.number = [""], {"": 0}

    def of(self, s: str) -> int:
        if s not in self.number:
            self.number[s] = len(self.strings)
            self.strings.append(s)
        return self.number[s]


MARKS = _Marks()
KEYS = _Keys()


class Units(NamedTuple):
    """Characters of a list of tokens, and the output units that they make, in order."""

    token: np.ndarray  # by unit
    body: np.ndarray  # code point by unit, 0 for none
    marks: np.ndarray  # number of the string of marks, by unit
    unit: np.ndarray  # by character
    joins: np.ndarray  # whether a character is a mark upon another's unit
    good: np.ndarray  # whether a character is mapped
    conf: np.ndarray  # by character
    lost: np.ndarray  # characters of unmapped units, by token
    loose: np.ndarray  # tokens whose units may combine with each other


def flat(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, token number, position in its token) of every character."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    code = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    token = np.repeat(np.arange(len(tokens)), size)
    return code, token, np.arange(len(code)) - (np.cumsum(size) - size)[token]


def _before(flag: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Index of the last flagged entry before each one in its token, else -1."""
    at = np.where(flag, np.arange(len(flag)), -1)
    seen = np.maximum.accumulate(np.concatenate([[-1], at[:-1]])) if len(at) else at
    return np.where(seen >= start, seen, -1)


def _after(flag: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Index of the first flagged entry after each one in its token, else -1."""
    n = len(flag)
    at = np.where(flag, np.arange(n), n)
    seen = np.minimum.accumulate(np.concatenate([at[1:], [n]])[::-1])[::-1] if n else at
    return np.where(seen <= end, seen, -1)


def units(tokens: list[str], tables: np.ndarray) -> Units:
    """Decode tokens under the tables of the numbers `tables`."""
    code, token, pos = flat(tokens)
    n, here = len(code), np.arange(len(code))
    size = np.bincount(token, minlength=len(tokens))
    start = here - pos
    end = start + size[token] - 1
    last = here == end
    key = np.where(code < BMP, KEYS.index[tables[token], np.minimum(code, BMP - 1)], 0)
    kind = KEYS.kind[key]
    letter = (kind == LETTER) | ((kind == FINAL_LETTER) & last)
    mark, vowel = kind == MARK, letter & KEYS.vowel[key]
    carrier = _before(vowel, start)
    carrier = np.where(KEYS.breathing[key], np.maximum(carrier, _before(letter & KEYS.rho[key], start)), carrier)
    target = np.where(mark, np.where(carrier >= 0, carrier, _after(letter, end)), -1)
    unit_before = _before(~mark, start)
    prev_letter = (unit_before >= 0) & letter[unit_before]
    prev_vowel = prev_letter & vowel[unit_before]
    accented = _before(mark & KEYS.accent[key] & (target >= 0) & (target < end), start) >= 0
    apostrophe = last & KEYS.final_apostrophe[key] & prev_letter & ~prev_vowel
    punct = last & (KEYS.final_punct[key] > 0) & (~prev_vowel | accented)
    literal = np.where(apostrophe, ord("’"), np.where(punct, KEYS.final_punct[key], np.where(kind == LITERAL, KEYS.out[key], 0)))
    joins = mark & (literal == 0)
    orphan = joins & (target < 0)
    queued = joins & ((target < 0) | (target > here))
    body = np.where(joins, 0, np.where(letter, KEYS.out[key], np.where(literal > 0, literal, np.where(kind == 0, code, 0))))
    # a unit is a character that is no mark, or, behind all others, the orphans of a token
    bound = np.zeros(len(tokens), np.int64)
    bound[token[orphan]] = 1
    heads = np.bincount(token[~joins], minlength=len(tokens)).astype(np.int64)
    first = np.cumsum(heads + bound) - (heads + bound)
    n_units = int((heads + bound).sum())
    number = np.cumsum(~joins) - 1 + (np.cumsum(bound) - bound)[token]
    unit = np.where(orphan, (first + heads)[token], number[np.where(joins, target, here)])
    unit_token = np.repeat(np.arange(len(tokens)), heads + bound)
    unit_body, unit_marks = np.zeros(n_units, np.int64), np.zeros(n_units, np.int64)
    unit_body[unit[~joins]] = body[~joins]
    at = np.flatnonzero(joins)
    owner = unit[at]
    one = np.bincount(owner, minlength=n_units)[owner] == 1
    unit_marks[owner[one]] = KEYS.marks[key[at[one]]]
    many: dict[int, str] = {}
    for i, o in zip(at[~one].tolist(), owner[~one].tolist(), strict=True):
        have, more = many.get(o, ""), MARKS.strings[KEYS.marks[key[i]]]
        many[o] = have + (more if queued[i] else "".join(m for m in more if m not in have))
    for o, marks in many.items():
        unit_marks[o] = MARKS.of(marks)
    good = ~orphan & (kind != 0)
    conf = np.where(~good, 0.0, np.where(queued, 1.0, KEYS.conf[key]))
    # a mark upon an unmapped character does not occur: carriers are letters
    lost = np.bincount(token[~good], minlength=len(tokens)).astype(np.int64)
    loose = np.unique(token[orphan | ((kind == 0) & (code >= COMBINES))])
    return Units(unit_token, unit_body, unit_marks, unit, joins, good, conf, lost, loose)


def _forms(u: Units) -> list[str]:
    """The normalised output of every unit."""
    pair, form = np.unique(u.body * (1 << 24) + u.marks, return_inverse=True)
    made = [unicodedata.normalize("NFC", (chr(p >> 24) if p >> 24 else "") + MARKS.strings[p & 0xFFFFFF]) for p in pair.tolist()]
    return list(map(made.__getitem__, form.tolist()))


def _bounds(by: np.ndarray, n: int) -> list[int]:
    return np.searchsorted(by, np.arange(n + 1)).tolist()


def _texts(tokens: list[str], u: Units, forms: list[str]) -> list[str]:
    cut = _bounds(u.token, len(tokens))
    return [SIGMA.sub("ς", unicodedata.normalize("NFC", "".join(forms[a:b]))) for a, b in zip(cut, cut[1:], strict=False)]


def decode(tokens: list[str], tables: np.ndarray) -> list[tuple[str, list[str], list[tuple[str, str, bool, float]], float]]:
    """(text, unmapped characters, records, confidence) of every token; a record is (output, source, mapped, confidence)."""
    if not tokens:
        return []
    u = units(tokens, tables)
    forms = _forms(u)
    rank = np.lexsort((np.arange(len(u.unit)), u.joins, u.unit))  # a unit's own character first, then its marks
    chars = np.array(list("".join(tokens)), object)[rank]
    cut = np.searchsorted(u.unit[rank], np.arange(len(u.token)))
    sources = [] if not len(cut) else ["".join(chars[a:b]) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(chars)], strict=True)]
    mapped, conf = (np.minimum.reduceat(x[rank], cut) if len(cut) else x for x in (u.good, u.conf))
    records = list(zip(forms, sources, mapped.tolist(), conf.tolist(), strict=True))
    cut, out = _bounds(u.token, len(tokens)), []
    for text, a, b in zip(_texts(tokens, u, forms), cut, cut[1:], strict=False):
        rs = records[a:b]
        out.append((text, [c for r in rs if not r[2] for c in r[1]], rs, min((r[3] for r in rs), default=1.0)))
    return out


def measure(tokens: list[str], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unmapped characters, characters of the text, Greek ones among them) of every token, without making its text."""
    u, n = units(tokens, tables), len(tokens)
    size, greek = (u.body > 0).astype(np.int64), IS_GREEK[np.minimum(u.body, BMP - 1)].astype(np.int64)
    marked = np.flatnonzero(u.marks)
    pair, form = np.unique(u.body[marked] * (1 << 24) + u.marks[marked], return_inverse=True)
    made = [unicodedata.normalize("NFC", (chr(p >> 24) if p >> 24 else "") + MARKS.strings[p & 0xFFFFFF]) for p in pair.tolist()]
    size[marked] = np.array([len(f) for f in made], np.int64)[form]
    greek[marked] = np.array([len(GREEK.findall(f)) for f in made], np.int64)[form]
    out, hits = (np.bincount(u.token, weights=x, minlength=n).astype(np.int64) for x in (size, greek))
    if len(u.loose):
        some = [tokens[i] for i in u.loose]
        v = units(some, tables[u.loose])
        for i, t in zip(u.loose.tolist(), _texts(some, v, _forms(v)), strict=True):
            out[i], hits[i] = len(t), len(GREEK.findall(t))
    return u.lost, out, hits


def _python(fragment: str) -> str:
    """A class of `text.py` in Python's notation."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), fragment)


GREEK = re.compile(f"[{_python(T.GREEK)}]")
IS_GREEK = np.zeros(BMP, bool)
IS_GREEK[[c for c in range(COMBINES, 0x2000) if GREEK.match(chr(c))]] = True
CHUNKS = re.compile(f"[^{_python(T.SPACE)}]+")


class _Classes:
    """For each table which characters separate tokens, keep a token and are mark keys."""

    def __init__(self):
        space, word = (re.compile(f"[{_python(c)}]") for c in (T.SPACE, T.WORD))
        every = [chr(c) if not 0xD800 <= c < 0xE000 else "" for c in range(BMP)]
        self.digit = np.array([c.isdecimal() for c in every])
        is_space, is_word = np.array([bool(space.match(c)) for c in every]), np.array([bool(word.match(c)) for c in every])
        self.separates, self.keeps, self.marks, self.digits = [], [], [], []
        for e in ENCODINGS:
            keys = e.keys()
            self.digits.append(not any(c.isdigit() for c in keys))
            separates = is_space | (self.digit if self.digits[-1] else False)
            separates[[ord(c) for c in T.SEPARATORS + e.separators if c not in keys]] = True
            keeps, marks = is_word.copy(), np.zeros(BMP, bool)
            keeps[[ord(c) for c in keys]] = True
            marks[[ord(c) for c in e.marks]] = True
            self.separates.append(separates)
            self.keeps.append(keeps)
            self.marks.append(marks)


CLASSES = _Classes()


def tokenize(chunks: list[str], table: int) -> tuple[np.ndarray, list[str]]:
    """(chunk number, token) of the tokens of text between spaces: `text.tokens`, chunk by chunk."""
    code, chunk, _ = flat(chunks)
    if not len(code):
        return np.zeros(0, np.int64), []
    low = np.minimum(code, BMP - 1)
    separates = np.where(code < BMP, CLASSES.separates[table][low], False)
    wide = np.flatnonzero(code >= BMP)
    if len(wide) and CLASSES.digits[table]:
        separates[wide] = [chr(c).isdecimal() for c in code[wide].tolist()]
    keeps = np.where(code < BMP, CLASSES.keeps[table][low], False)
    new = np.concatenate([[True], (chunk[1:] != chunk[:-1]) | separates[:-1] | separates[1:]])
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(code))
    text = "".join(chunks)
    some = np.zeros(len(first), bool)
    solid = code != ord("-")
    # a hyphen counts as a word character only between others, and between them is one of those
    some[run[~separates & solid & keeps]] = True
    odd = np.zeros(len(first), bool)
    odd[run[~separates & solid]] = True
    hyphens = np.zeros(len(first), bool)
    hyphens[run[~separates & ~solid]] = True
    where, out = [], []
    for i in np.flatnonzero(some | (odd & hyphens)).tolist():
        t = text[first[i] : end[i]]
        if hyphens[i]:
            t = t.strip("-")
            if not some[i] and "-" not in t:
                continue
        where.append(i)
        out.append(t)
    return chunk[first[where]] if where else np.zeros(0, np.int64), out


def coded(tokens: list[str], table: int) -> np.ndarray:
    """Which tokens hold a mark key of the table."""
    code, token, _ = flat(tokens)
    out = np.zeros(len(tokens), bool)
    out[token[(code < BMP) & CLASSES.marks[table][np.minimum(code, BMP - 1)]]] = True
    return out
