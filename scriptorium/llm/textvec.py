"""Hashed tokens of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_BLANK, _LETTER, _SYMBOL = 0, 1, 2
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[:33] = _BLANK
for _lo, _hi in (("0", "9"), ("A", "Z"), ("a", "z")):
    _KIND[ord(_lo) : ord(_hi) + 1] = _LETTER
_KIND[128:] = _LETTER
_MULT = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, 1 << 20)
        for name, m in (("_POW", _MULT), ("_INV", pow(_MULT, -1, 1 << 64))):
            x = np.full(n, m, np.uint64)
            x[0] = 1
            globals()[name] = np.cumprod(x, dtype=np.uint64)
    return _POW, _INV


def scramble(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tokens(docs: list[bytes], symbols: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number) of every run of letters and, if asked for, of every run of symbols.

    The hash is a polynomial in the run's bytes alone: prefix sums make it a subtraction for
    each run, whatever its length."""
    buf = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
    kind = _KIND[buf]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(_BLANK)))
    ends = np.append(edge[1:], len(buf))
    keep = (kind[edge] == _LETTER) | ((kind[edge] == _SYMBOL) & symbols)
    starts, ends = edge[keep], ends[keep]
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    bounds = np.cumsum([len(x) + 1 for x in docs])
    return scramble(h), np.searchsorted(bounds, starts, side="right")


def slices(docs: list[bytes], size: int = 1 << 20):
    """Ranges of documents of about `size` bytes in all; a longer document comes alone."""
    at, held = 0, 0
    for i, x in enumerate(docs):
        if held and held + len(x) > size:
            yield at, i
            at, held = i, 0
        held += len(x) + 1
    if at < len(docs):
        yield at, len(docs)
