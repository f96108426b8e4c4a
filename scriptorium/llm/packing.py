"""Packing documents into fixed-length sequences along a Hilbert curve.

Every document's hashed word vector is projected to four dimensions; the Hilbert index of
that point is its place on a curve on which neighbours are alike. Rows are range-sorted by
that key (with a hash of the id, so that many copies of one text spread over tasks), and
each range is tokenised and cut into sequences of 1,024 as it streams by. What is left at
the end of a range is cut into powers of two, which are not padded: no id is padding.

Documents that come in an order of their own, such as a mix of sources, keep it: the curve
then runs anew through each window of that order, windows follow each other, and so do the
numbers of their sequences.

Defined cases: a null or empty text is the single id 0 (the end mark); a null doc_id keeps
its null; repeated rows are packed each; an empty table gives no rows; extra columns are not
read."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, texts
from .textvec import scramble, slices, tokens

LENGTH, END = 1024, 0
#: Bytes of text in a range of the curve, about.
RANGE = 16 << 20
DIMS, BITS, HASHED = 4, 10, 1 << 12
#: How the vocabulary file writes bytes that do not print as characters, and
#: the pattern that splits a text before merging.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(merge ranks by bytes, special tokens) of a byte-level BPE file; the ids are the ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    other = [b for b in range(256) if b not in PLAIN]
    byte = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(other)}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return ranks, special


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    A single space or line feed between other characters always starts a new pre-token, so a
    text falls into chunks whose ids do not depend on their neighbours; a bounded memory of
    chunks saves most of the merging. A text with any other white space is encoded whole."""

    LIMIT = 1 << 18

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int]):
        import tiktoken

        self.special, self.known = special, {}
        self.bpe = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def whole(self, text: str) -> bytes:
        ids = self.bpe.encode(text, allowed_special="all") if any(s in text for s in self.special) else self.bpe.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def _chunk(self, c: str) -> bytes | None:
        if c == "\n" or (c and not c[c[0] == " " :].isspace() and c != " " and len(c.split()) == 1 and c.split()[0] == c[c[0] == " " :]):
            return np.array(self.bpe.encode_ordinary(c), "<u4").tobytes()
        return None

    def __call__(self, text: str) -> bytes:
        if not text or "\x01" in text or "<|" in text:
            return self.whole(text) if text else b""
        chunks = text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")
        known = self.known
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            if len(known) > self.LIMIT:
                known.clear()
            for c in chunks:
                if c not in known:
                    ids = self._chunk(c)
                    if ids is None:
                        return self.whole(text)
                    known[c] = ids
            return b"".join(map(known.__getitem__, chunks))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n x d), by Gray-code rotations of the axes."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            up = (x[i] & q) > 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _directions() -> np.ndarray:
    h = scramble(np.arange(HASHED * DIMS * 4, dtype=np.uint64)).reshape(HASHED, DIMS, 4)
    return ((h >> np.uint64(40)).astype(np.float64) / 2**24 - 0.5).sum(2).astype(np.float32)


def curve_keys(docs: list[bytes]) -> np.ndarray:
    """Hilbert key of every document: hashed words, projected, scaled to unit length, quantised."""
    directions = _directions()
    v = np.zeros((len(docs), DIMS), np.float32)
    for i, j in slices(docs):
        h, doc = tokens(docs[i:j], symbols=False)
        if len(h):
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            v[doc[first] + i] = np.add.reduceat(directions[(h % np.uint64(HASHED)).astype(np.int64)], first, axis=0)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return hilbert(np.clip(((v + 1) * (1 << (BITS - 1))).astype(np.int64), 0, (1 << BITS) - 1))


def _pieces(held: list[tuple], length: int):
    """Cut the start of `held` (doc_id, start, ids, doc_tokens) into one sequence of `length` ids."""
    out, at = [], 0
    while at < length:
        doc, start, ids, total = held.pop(0)
        n = min(len(ids) // 4, length - at)
        out.append((doc, start, n, ids[: 4 * n], total, at))
        if n < len(ids) // 4:
            held.insert(0, (doc, start + n, ids[4 * n :], total))
        at += n
    return out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, windows: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    `vocabulary` is the path of the tokenizer file, read on the driver only. `windows` are long
    columns: rows equal in them are a window, and windows are packed in their order."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary))  # of the file's size

    def keyed(batches):
        for b in batches:
            yield b.append_column("key", pa.array(curve_keys(texts(b))))

    def cut(batches):
        encode = Encoder(*shared.value)
        base, number = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []
        size = 0
        end = np.array([END], "<u4").tobytes()

        def batch(rows):
            d, s, n, ids, total, off, seq = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                start = 0
                while size + total - start >= length:  # the open sequence is filled
                    n = length - size
                    held.append((doc, start, ids[4 * start : 4 * (start + n)], total))
                    at = 0
                    for d, s, x, t in held:
                        rows.append((d, s, len(x) // 4, x, t, at, base + number))
                        at += len(x) // 4
                    number, start, size = number + 1, start + n, 0
                    held.clear()
                if start < total:
                    held.append((doc, start, ids[4 * start :], total))
                    size += total - start
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
        power = 1 << (length - 1).bit_length()
        while held:
            left = sum(len(x[2]) for x in held) // 4
            while power > left:
                power >>= 1
            rows += [(*p, base + number) for p in _pieces(held, power)]
            number += 1
        if rows:
            yield batch(rows)

    at = [f"window{i}" for i in range(len(windows))]
    d = docs.select("doc_id", "text", *(F.col(c).cast("long").alias(a) for c, a in zip(windows, at, strict=True)))
    key = d.mapInArrow(keyed, ", ".join(["doc_id long, text string", *(f"{a} long" for a in at), "key long"]))
    # ranges of a bounded size; rows of one key, id and text differ by a number, and are alike
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // RANGE))
    ties = [F.xxhash64("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    key = key.select("*", *(t.alias(f"tie{i}") for i, t in enumerate(ties)))
    by = [*at, "key", "tie0", "tie1", "tie2"]
    order = key.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return order.select("doc_id", "text").mapInArrow(cut, SCHEMA)


def op9_packing(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
