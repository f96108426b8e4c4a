"""Ranking encodings for a text, and refusing what does not look encoded.

A text's sample is ranked in its own row: its chunks between spaces are measured once for all
tables, remembered up to a bound, and added up. Nothing shuffles, so rows with null or repeated
ids stay apart.

Defined cases: a null or empty text scores 0 under every table and is refused; ties go to the
table that is registered first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..functions.keytables import ENCODINGS

SAMPLE_CHARS, SAMPLE_TOKENS, LEAST_CODED = 4000, 400, 0.15
NAMES = [ENCODINGS[t].table_id for t in K.TEXT_TABLES]
#: What is measured of a chunk under a table.
TOKENS, LENGTH, LOST, OUT, GREEK, CODED = range(6)
#: Chunks that a worker remembers, and rows measured together.
REMEMBERED, SLICE = 1 << 18, 512
SCORE = "struct<table_id:string,score:double,mapped_ratio:double,greek_ratio:double,code_token_ratio:double>"
_SCORE = pa.struct([("table_id", pa.string()), *((c, pa.float64()) for c in ("score", "mapped_ratio", "greek_ratio", "code_token_ratio"))])


def measured(chunks: list[str], table: int) -> tuple[np.ndarray, np.ndarray]:
    """(chunk number, 6 measures) of every token of `chunks` under a table."""
    chunk, tokens = K.tokenize(chunks, table)
    lost, out, greek = K.measure(tokens, np.full(len(tokens), table))
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return chunk, np.stack([np.ones(len(tokens), np.int64), length, lost, out, greek, K.coded(tokens, table).astype(np.int64)], 1)


class _Memory:
    def __init__(self):
        self.at: dict[str, int] = {}
        self.sums = np.zeros((0, len(NAMES), 6), np.int16)

    def rows(self, chunks: list[str]) -> np.ndarray:
        """Numbers of `chunks` in `sums`."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.at]
        if len(self.at) + len(new) > REMEMBERED:
            self.at, self.sums = {}, self.sums[:0]
            new = list(dict.fromkeys(chunks))
        if new:
            more = np.zeros((len(new), len(NAMES), 6), np.int16)  # a chunk has SAMPLE_CHARS characters at most
            for i in range(0, len(new), 8192):
                for k, t in enumerate(K.TEXT_TABLES):
                    chunk, m = measured(new[i : i + 8192], t)
                    np.add.at(more[:, k], chunk + i, m.astype(np.int16))
            n = len(self.at)
            if n + len(new) > len(self.sums):
                grown = np.zeros((min(REMEMBERED + len(new), max(2 * len(self.sums), n + len(new))), len(NAMES), 6), np.int16)
                grown[:n] = self.sums[:n]
                self.sums = grown
            self.sums[n : n + len(new)] = more
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))


_MEMORY = _Memory()


def rates(samples: list[str | None]) -> np.ndarray:
    """score, mapped_ratio, greek_ratio, code_token_ratio of every text under every table: texts x tables x 4.

    Every token counts below a ratio's line, the first SAMPLE_TOKENS above it."""
    split = [K.CHUNKS.findall(s or "") for s in samples]
    size = np.fromiter(map(len, split), np.int64, len(split))
    chunks = [c for cs in split for c in cs]
    n, k = len(split), len(NAMES)
    every, used = np.zeros((n, k, 6), np.int64), np.zeros((n, k, 6), np.int64)
    if chunks:
        at = _MEMORY.rows(chunks)
        m = _MEMORY.sums[at].astype(np.int32)
        full = np.flatnonzero(size)
        starts = (np.cumsum(size) - size)[full]
        every[full] = np.add.reduceat(m, starts, axis=0)
        used[:] = every
        for d in np.flatnonzero((every[:, :, TOKENS] > SAMPLE_TOKENS).any(1)).tolist():
            a = int(size[:d].sum())
            mine = m[a : a + size[d]]
            seen = np.cumsum(mine[:, :, TOKENS], 0)
            for t in np.flatnonzero(every[d, :, TOKENS] > SAMPLE_TOKENS).tolist():
                whole = int(np.searchsorted(seen[:, t], SAMPLE_TOKENS, "right"))
                used[d, t] = mine[:whole, t].sum(0)
                left = SAMPLE_TOKENS - int(used[d, t, TOKENS])
                if left:  # the limit falls within a chunk
                    used[d, t] += measured([split[d][whole]], K.TEXT_TABLES[t])[1][:left].sum(0)
    ratio = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    mapped = (used[:, :, LENGTH] - used[:, :, LOST]) / np.maximum(every[:, :, LENGTH], 1)
    greek, coded = ratio(used[:, :, GREEK], used[:, :, OUT]), ratio(used[:, :, CODED], every[:, :, TOKENS])
    return np.stack([mapped * greek * np.minimum(1.0, coded / 0.3), mapped, greek, coded], 2)


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "__sample"]
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            r = rates(part.column("__sample").to_pylist())
            order = np.argsort(-r[:, :, 0], axis=1, kind="stable")
            first = np.take_along_axis(r, order[:, :1, None], 1)[:, 0]
            flat = np.take_along_axis(r, order[:, :, None], 1).reshape(-1, 4)
            names = pa.array(NAMES).take(pa.array(order.ravel()))
            scores = pa.StructArray.from_arrays([names, *(pa.array(flat[:, c]) for c in range(4))], fields=list(_SCORE))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(NAMES)), pa.int32()), scores)
            best = pa.array(NAMES).take(pa.array(order[:, 0]))
            refused = (first[:, 0] == 0) | (first[:, 3] < LEAST_CODED)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), best, pa.array(first[:, 0]), pa.array(refused), listed], names=[*rest, "table_id", "score", "refused", "detection"])


def ranked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, `keep`, table_id, score, refused of the best encoding of every row, and detection: all tables, best first."""
    kept = [id_col, *(keep or [])]
    named = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)], F.substring(F.col(text_col), 1, SAMPLE_CHARS).alias("__sample"))
    fields = ", ".join(f"__k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    out = named.mapInArrow(_rank, f"{fields}, table_id string, score double, refused boolean, detection array<{SCORE}>")
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], "table_id", "score", "refused", "detection")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, table_id, score, mapped_ratio, greek_ratio, code_token_ratio, rank for every text table."""
    r = ranked(docs, id_col, text_col).select(id_col, F.posexplode("detection").alias("p", "s"))
    return r.select(id_col, "s.*", (F.col("p") + 1).alias("rank"))


def best(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, table_id, score, refused of the best encoding of every row."""
    return ranked(docs, id_col, text_col, keep).drop("detection")
