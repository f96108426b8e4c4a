"""SimHash near-duplicates by Golay-code fuzzy keys.

The 64-bit fingerprint falls into three segments of 22, 21 and 21 bits. Two fingerprints
within 2 bits agree on at least one whole segment (pigeonhole) and differ by at most 2 bits
in the segment after it. The binary Golay code [23, 12, 7] is perfect: every 23-bit word is
within 3 bits of exactly one codeword. The keys of a segment are the codeword indices of the
segment and of its one-bit neighbours, one index or six: two segments within 2 bits have a
word between them that is within one bit of both, and share its index. A fingerprint's keys
therefore join an exact segment with a fuzzy index of the next, about 16 keys of 34 bits.

Only distinct fingerprints are keyed. Within a key a task links each fingerprint to the
smallest it can reach, by blocks of Hamming distances or, in a large bucket, by looking up
every one of the 904 patterns that the shared segment leaves free; it never emits all pairs.
Components of these links are found by table operations.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links
like any other; repeated rows are one group; the smallest doc_id that is not null names a
group, null where there is none; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts, small_batches, table, texts
from .components import components

SHINGLE, DISTANCE, SEED = 3, 2, 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, width) from the high bits down
_GENERATOR = 0xAE3  # of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
#: A fingerprint with more than one of so many shares of all rows is split when rows are named.
SHARES = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _remainders(x: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words by the generator polynomial."""
    x = x.astype(np.uint32)
    for bit in range(22, 10, -1):
        x = np.where(x >> np.uint32(bit) & np.uint32(1), x ^ np.uint32(_GENERATOR << (bit - 11)), x)
    return x


def _corrections() -> np.ndarray:
    """The error pattern of at most 3 bits for each of the 2,048 syndromes."""
    one = 1 << np.arange(23, dtype=np.uint32)
    two = (one[:, None] | one).ravel()
    errors = np.unique(np.concatenate([[np.uint32(0)], one, two, (two[:, None] | one).ravel()]))
    out = np.zeros(2048, np.uint32)
    out[_remainders(errors)] = errors
    return out


_ERRORS = _corrections()


def codeword_index(x: np.ndarray) -> np.ndarray:
    """The 12 data bits of the codeword nearest to each 23-bit word."""
    return (x ^ _ERRORS[_remainders(x)]) >> np.uint32(11)


def fuzzy_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the distinct codeword indices of each word and of its 23 neighbours."""
    x = x.astype(np.uint32)
    flips = np.concatenate([[np.uint32(0)], 1 << np.arange(23, dtype=np.uint32)]).astype(np.uint32)
    idx = np.sort(codeword_index((x[:, None] ^ flips).ravel()).reshape(len(x), -1), axis=1)
    new = np.ones(idx.shape, bool)
    new[:, 1:] = idx[:, 1:] != idx[:, :-1]
    rows = np.broadcast_to(np.arange(len(x))[:, None], idx.shape)[new]
    return rows, idx[new]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, key) pairs: segment number, exact segment and fuzzy index of the next one."""
    fps, out = [], []
    for s, (shift, width) in enumerate(SEGMENTS):
        mine = fp >> np.uint64(shift) & np.uint64((1 << width) - 1)
        shift, width = SEGMENTS[(s + 1) % 3]
        rows, idx = fuzzy_keys(fp >> np.uint64(shift) & np.uint64((1 << width) - 1))
        fps.append(fp[rows])
        out.append(np.uint64(s) << np.uint64(34) | mine[rows] << np.uint64(12) | idx.astype(np.uint64))
    return np.concatenate(fps), np.concatenate(out)


def fingerprint(texts_: list[bytes]) -> np.ndarray:
    """SimHash of the 3-word shingles of each text, as uint64."""
    out = np.zeros(len(texts_), np.uint64)
    h64 = xxhash.xxh64_intdigest
    for i, t in enumerate(texts_):
        w = t.translate(_LOWER).split()
        if not w:
            continue
        whole = [b" ".join(w)] if len(w) < SHINGLE else map(b" ".join, zip(w, w[1:], w[2:], strict=False))
        h = np.fromiter((h64(s, SEED) for s in whole), np.uint64)
        ones = np.zeros(64, np.int64)
        for k in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[i] = int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")
    return out


def fingerprints(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, signed 64-bit `fp` and `columns` of every row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fp": pa.array(fingerprint(texts(b)).view(np.int64)), **{c: b.column(c) for c in columns}})

    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", *columns)
    return docs.mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)]))


def _keyed(batches):
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for i in range(0, len(fp), 4096):
            f, k = keys(fp[i : i + 4096])
            yield pa.RecordBatch.from_pydict({"key": pa.array(k.view(np.int64)), "fp": pa.array(f.view(np.int64))})


def _patterns(segment: int) -> np.ndarray:
    """Differences of 1 or 2 bits outside of a segment."""
    shift, width = SEGMENTS[segment]
    one = np.array([1 << i for i in range(64) if not shift <= i < shift + width], np.uint64)
    two = (one[:, None] | one)[np.triu_indices(len(one), 1)]
    return np.concatenate([one, two])


def _root(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def bucket_links(fp: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest one of its component) of the sorted distinct members of one bucket."""
    n = len(fp)
    parent = np.arange(n)

    def join(a, b):
        nonlocal parent
        while len(a):
            ra, rb = parent[a], parent[b]
            lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
            if (lo == hi).all():
                return
            np.minimum.at(parent, hi, lo)
            parent = _root(parent)

    if n <= 2048:
        step = max(1, (1 << 20) // n)
        for i in range(0, n, step):
            near = np.bitwise_count(fp[i : i + step, None] ^ fp[None, i:]) <= DISTANCE
            a, b = np.nonzero(near)
            join(a + i, b + i)
    else:
        for p in _patterns(segment):
            at = np.minimum(np.searchsorted(fp, fp ^ p), n - 1)
            hit = np.flatnonzero(fp[at] == fp ^ p)
            join(hit, at[hit])
    moved = np.flatnonzero(parent != np.arange(n))
    return fp[moved], fp[parent[moved]]


def _linked(batches):
    """Links of the buckets of one partition, which is sorted by key and fingerprint."""
    key, held = None, []

    def links(k, parts_):
        fp = np.unique(np.concatenate(parts_).view(np.uint64))
        return bucket_links(fp, int(k >> 34)) if len(fp) > 1 else (fp[:0], fp[:0])

    for b in batches:
        if not b.num_rows:
            continue
        ks, fs = b.column("key").to_numpy(), b.column("fp").to_numpy()
        cut = np.append(np.flatnonzero(np.diff(ks)) + 1, len(ks))
        at, out = 0, []
        for to in cut.tolist():
            if ks[at] != key:
                if key is not None and sum(map(len, held)) > 1:
                    out.append(links(key, held))
                key, held = ks[at], []
            held.append(fs[at:to])
            at = to
        if out:
            a, c = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(c)})
    if key is not None and sum(map(len, held)) > 1:
        a, c = links(key, held)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(c.view(np.int64))})


def groups(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id, component and `columns` of every row of `docs`.

    `component` is the smallest fingerprint of the group, and tells groups without an id apart."""
    fps = materialise(fingerprints(docs, columns), "fingerprints")
    once = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    links = once.select("fp").mapInArrow(_keyed, "key long, fp long").repartition(F.col("key")).sortWithinPartitions("key", "fp").mapInArrow(_linked, "a long, b long")
    c = components(links)
    # only fingerprints with a near neighbour have a component of their own to look up
    part = c.join(once, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("first").alias("component_id"))
    named = once.join(c, F.col("fp") == F.col("node"), "left").join(part, "component", "left")
    # rows of a fingerprint that has many meet its name in several tasks
    each = parts(fps.count(), SHARES)
    pieces = F.ceil(F.col("copies") / each)
    named = named.select("fp", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("component", "fp").alias("component"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("__piece"))
    split = once.where(F.col("copies") > each).select("fp", pieces.alias("__pieces"))  # fewer than SHARES rows
    rows = fps.withColumn("__number", F.monotonically_increasing_id()).join(F.broadcast(split), "fp", "left")
    rows = rows.withColumn("__piece", F.pmod(F.col("__number"), F.coalesce("__pieces", F.lit(1).cast("long"))))
    return rows.join(named, ["fp", "__piece"]).select("doc_id", "fp", "component_id", "component", *columns)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
