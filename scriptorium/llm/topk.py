"""Exact top-k by inner product: term-at-a-time accumulation over blocks.

Rows fall into blocks that are packed once: a block keeps for every dimension its postings, the
components of its rows, zeros left out where most are zero. A block of queries adds weight times
posting into a dense array of scores, one dimension at a time, without skipping any candidate.
Each pair of blocks keeps its k best of each query by partition selection; a window merges them.
Block sizes bound every task, and a query block is as large as a worker's memory allows, since
every candidate block is sent once for each of them.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do
rows without a vec_id; a shorter vector counts as zeros beyond its end, and an empty one scores
0; a row is no candidate of its own, while other rows with its vec_id are, and each query row has
ranks of its own; ties go to the smaller vec_id; sums are exact whatever the components, and a
score beyond a long's range is returned as the nearest long; an empty table gives no rows; long
vectors are held whole; extra columns are not read, whatever their names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts, table

QUERY_BLOCK, CANDIDATE_BLOCK = 16384, 8192
#: Queries whose scores are held together.
ROWS = 32
LONG = (-(2**63), 2**63 - 1)


def accumulate(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores of every query (rows) with every candidate (columns of `postings`), one dimension after another.

    Of exact integers: 32 or 64 bits where no sum can exceed them, else Python's."""
    width = min(queries.shape[1], len(postings))
    q, c = queries[:, :width], postings[:width]
    top = lambda x: max(-int(x.min(initial=0)), int(x.max(initial=0)))
    bound = top(q) * top(c) * max(width, 1)
    dtype = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    q, c = q.astype(dtype), c.astype(dtype)
    scores = np.zeros((len(q), c.shape[1]), dtype)
    held = np.empty_like(scores)
    for t in range(width):
        rows, posting = np.flatnonzero(q[:, t]), np.flatnonzero(c[t])
        if 2 * len(posting) < c.shape[1]:
            scores[np.ix_(rows, posting)] += q[rows, t, None] * c[t, posting]
        elif len(rows) == len(q):
            scores += np.multiply(q[:, t, None], c[t], out=held)
        else:
            scores[rows] += q[rows, t, None] * c[t]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores of one query, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    order = np.lexsort((ids[at], -scores[at])) if scores.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (-scores[at[i]], ids[at[i]])), np.int64)
    return at[order][:k]


def _pack(pdf: pd.DataFrame) -> dict:
    """A block's columns: ids, row numbers and the components of each dimension."""
    width = max(map(len, pdf["x"]), default=0)
    x = np.zeros((len(pdf), width), np.int64)
    for i, v in enumerate(pdf["x"]):
        x[i, : len(v)] = v
    # the narrowest integers that hold them
    small = next((t for t in (np.int16, np.int32) if not x.size or np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max), np.int64)
    return {"n": [len(pdf)], "bytes": [np.dtype(small).itemsize], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "rows": [pdf["row"].to_numpy(np.int64).tobytes()], "x": [np.ascontiguousarray(x.T.astype(small)).tobytes()]}


def _unpack(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row numbers, dimensions x rows)."""
    x = np.frombuffer(r.x, {2: np.int16, 4: np.int32, 8: np.int64}[r.bytes])
    return np.frombuffer(r.ids, np.int64), np.frombuffer(r.rows, np.int64), x.reshape(-1, r.n) if r.n else x.reshape(0, 0)


BLOCK = "n long, bytes int, ids binary, rows binary, x binary"


def search(vectors: DataFrame, queries: str, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row of `vectors` for which the SQL condition `queries` holds.

    `vectors` has vec_id long and x array<long>."""
    # written once: a row keeps its number
    rows = materialise(vectors.select("vec_id", "x", F.monotonically_increasing_id().alias("row")), "vectors")
    asked = rows.where(queries)
    nc, nb = parts(rows.count(), CANDIDATE_BLOCK), parts(asked.count(), QUERY_BLOCK)
    h = F.xxhash64("row")
    c = rows.withColumn("cb", F.pmod(h, F.lit(nc)).cast("int")).groupBy("cb").applyInPandas(lambda key, pdf: pd.DataFrame({"cb": [key[0]], **_pack(pdf)}), f"cb int, {BLOCK}")
    q = asked.withColumn("qb", F.pmod(h, F.lit(nb)).cast("int")).groupBy("qb").applyInPandas(lambda key, pdf: pd.DataFrame({"qb": [key[0]], **_pack(pdf)}), f"qb int, {BLOCK}")
    c = materialise(c, "blocks").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            q_ids, q_rows, x = _unpack(left.iloc[0])
            ids, own, postings = _unpack(right.iloc[0])
            for i in range(0, len(q_ids), ROWS):
                scores = accumulate(x[:, i : i + ROWS].T, postings)
                for q_id, row, s in zip(q_ids[i : i + ROWS], q_rows[i : i + ROWS], scores, strict=True):
                    at = best(s, ids, k + 1)
                    at = at[own[at] != row]
                    if len(at) > k:
                        at = at[:k]
                    score = np.array([min(max(int(v), LONG[0]), LONG[1]) for v in s[at]], np.int64)
                    # beyond a long's range the order is that of the exact sums
                    over = np.array([float(int(v) - int(w)) for v, w in zip(s[at], score, strict=True)])
                    out.append(pd.DataFrame({"row": row, "query_id": q_id, "vec_id": ids[at], "score": score, "over": over}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": [], "over": []}).astype({"row": "int64", "query_id": "int64", "vec_id": "int64", "score": "int64"})

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(run, "row long, query_id long, vec_id long, score long, over double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.desc("over"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and x = floor(scale * component) of the vectors that take part."""
    d = F.col("embedding").cast("array<double>")
    good = F.forall(d, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(d, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return search(scaled(table(spark, sf_dir, "embeddings")), "vec_id % 50 = 0", 5)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
