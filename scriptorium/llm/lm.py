"""Language-model scores by logistic context mixing over the bits of words.

A text is lower-cased (A-Z) and read as words, each with an end mark, then one end token.
Every byte is a path of binary decisions in a fixed prefix code. Several predictors look a
decision up by a hash of its context: the one, two, three and four bytes before in the running
text, over word ends, and all of the word so far. Their log-odds are combined by weights that a
gate selects (how much evidence the long contexts have), and an adaptive table then refines the
result. Tables, weights and refinement are learned from every decision of every training text.
The weights are learned online, block after block, each decision left out of its own evidence.

The longest order sees the word before from a word's first HEAD bytes alone, its head. So all
decisions of running text are those of its heads, each in the bytes before it, and those of its
words behind the heads: they are told apart, counted, and learned from as often as they occur.

Beside the mixed bits a word that was met has an exact count, which gives up a discount for the
others. A text's score weighs several shares of the two, each over the whole text, as Bayes does
with equal weights before it. Phrases, which end at words that their bytes choose, have counts
one level up, which makes copied text cheap. A document that was learned from takes its own
words, heads and phrases away from what it is scored by, so that its score is as good as a
held-out one's.

Documents fall into blocks of a bounded size, in the order in which they are read. The bit model
runs once for each distinct word of a block, and for heads that a worker does not remember. All
counts cover every training text. The bit tables have a fixed size; counts travel by shuffles
keyed by word, one row for each word and block.

Defined cases: a null text is empty: one end token; a null doc_id is scored and not learned
from; rows with one id are documents each, and repeated rows score alike; very long texts are
scored whole, alone in their block; an empty table gives no rows; extra columns are not read,
whatever their names."""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks_of, fold, materialise, small_batches, sum_arrays, table
from .textvec import _powers, scramble, slices

#: Bytes from common to rare, which get short codes. They only set how many
#: binary decisions a byte takes; the rest of the 256 bytes follow in numeric order.
COMMON = b" etnaiorshdlcu\xc3mgfpwbv.,y\n-k'\xa9\xb3zxqj0123456789\xa8\xbc\xb6\xa4\xb1\xad\xa1!?*|%#&$"
SLOTS, ORDERS = 1 << 19, (1, 2, 3, 4)
K = len(ORDERS) + 1
LEVELS = 4
GATES = LEVELS * LEVELS
APM_BINS, APM_CTX = 33, 256
#: Words in a phrase, about.
PHRASE = 16
#: Bytes of a word that the longest order still sees from the word before: its head.
HEAD = ORDERS[-1] - 1
#: What stands before a text's first word, but for the space before each word.
START = b"\n" * HEAD
#: Heads whose bits a worker keeps from one block to the next, at most.
HEADS_KEPT = 1 << 19
#: Shares of the mixed bits beside the counts, of which every text weighs all.
SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Bytes of text whose words are looked up together; a longer document is a block alone.
BLOCK = 8 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offset, length, node, bit): every byte's path in an exponential-Golomb code of its rank."""
    order = list(dict.fromkeys(COMMON)) + [b for b in range(256) if b not in COMMON]
    node_of: dict[str, int] = {}
    off, length, nodes, bits = np.zeros(256, np.int64), np.zeros(256, np.int64), [], []
    for rank, b in enumerate(order):
        n = rank + 4
        tail = bin(n)[3:]
        path = "1" * (len(tail) - 2) + "0" + tail
        off[b], length[b] = len(nodes), len(path)
        for i, c in enumerate(path):
            nodes.append(node_of.setdefault(path[:i], len(node_of)))
            bits.append(int(c))
    return off, length, np.array(nodes, np.int64), np.array(bits, np.int64)


OFF, LENGTH, NODE, BIT = _code()
_NODE_MIX = (scramble(np.arange(512, dtype=np.uint64) + np.uint64(0x1234567)) >> np.uint64(32)).astype(np.uint32)
_PATH_MIX = _NODE_MIX[NODE]


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_LOWER).split()


class Vocabulary:
    """Numbers of a block's distinct words, with two hashes of each and whether it ends a phrase.

    One word in PHRASE does, by its bytes, and the end token."""

    def __init__(self):
        self.at: defaultdict[bytes, int] = defaultdict()
        self.hashes = np.zeros((2, 0), np.uint64)
        self.ends = np.zeros(0, bool)

    def add(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """Numbers of `words`, new ones included."""
        n = len(self.at)
        self.at.default_factory = self.at.__len__  # a new word's number, in the one pass that finds the others'
        ids = self.ids(words)
        self.at.default_factory = None
        new = list(islice(self.at, n, None))
        if not new:
            return ids
        if n + len(new) > len(self.ends):
            grown = max(2 * len(self.ends), n + len(new))
            self.hashes = np.concatenate([self.hashes, np.zeros((2, grown - len(self.ends)), np.uint64)], 1)
            self.ends = np.append(self.ends, np.zeros(grown - len(self.ends), bool))
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, new)), "<u8").reshape(-1, 2)
        self.hashes[:, n : n + len(new)] = h.T
        self.ends[n : n + len(new)] = np.fromiter(map(zlib.crc32, new), np.uint32, len(new)) % PHRASE == 0  # 0 for b""
        return ids

    def ids(self, words: list[bytes] | pa.Array) -> np.ndarray:
        if isinstance(words, pa.Array):  # each distinct word is looked up once
            found = words.dictionary_encode()
            return self.ids(listed(found.dictionary))[found.indices.to_numpy()]
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def phrases(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first token, 2 x n hashes) of the phrases that the tokens of whole documents fall into."""
        ends = np.flatnonzero(self.ends[ids]) + 1
        starts = np.append(0, ends[:-1])[: len(ends)]
        power, inverse = _powers(len(ids) + 1)
        out = np.empty((2, len(ends)), np.uint64)
        for k in range(2):
            sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(self.hashes[k][ids] * power[: len(ids)], out=sums[1:])
            out[k] = scramble((sums[ends] - sums[starts]) * inverse[starts])
        return starts, out


def listed(column: pa.Array) -> list:
    """to_pylist of a binary column, in one pass outside Python."""
    return column.to_numpy(zero_copy_only=False).tolist()


def column_of(size: np.ndarray, body: np.ndarray) -> pa.Array:
    """Values of so many bytes each, side by side in `body`, as a binary column."""
    ends = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each value starts, and the last one ends; bytes of all values) of a binary column."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return ends - ends[0], body


def tokens_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all texts as `words_of` has them, each with its end token; number of tokens of each)."""
    buf = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER), np.uint8)
    live = ~_BLANK[buf]
    edge = np.flatnonzero(np.diff(live, prepend=False))
    first, last = edge[::2], edge[1::2]
    ends = np.searchsorted(first, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
    return column_of(np.insert(last - first, ends, 0), buf[live]), np.diff(ends, prepend=0) + 1


def heads_of(words: list[bytes] | pa.Array, size: np.ndarray) -> np.ndarray:
    """The head of every token of whole documents, as HEAD bytes of running text before the space
    and HEAD bytes of the token with its end mark, filled up with line ends, in one number."""
    at, body = bytes_of(pa.array(words, pa.binary()) if isinstance(words, list) else words)
    last = np.cumsum(size) - 1  # end tokens
    # the running text: START and a space before a document, and an end mark behind every token
    first = at[:-1] + np.arange(len(at) - 1) + (HEAD + 1) * np.repeat(np.arange(1, len(size) + 1), size)
    buf = np.full(len(body) + len(first) + (HEAD + 1) * len(size) + HEAD, 32, np.uint8)
    told = np.ones(len(buf), bool)
    told[first + np.diff(at)] = False
    begin = first[last - size + 1]
    for k in range(1, HEAD + 2):
        told[begin - k] = False
        buf[begin - k] = 32 if k == 1 else 10
    told[len(buf) - HEAD :] = False
    buf[len(buf) - HEAD :] = 10
    buf[first[last]] = 10
    buf[told] = body
    key = np.zeros(len(first), np.uint64)
    for k in range(-HEAD - 1, -1):
        key = key << np.uint64(8) | buf[first + k]
    live = np.ones(len(first), bool)
    for k in range(HEAD):
        b = buf[first + k]
        key = key << np.uint64(8) | np.where(live, b, 10).astype(np.uint64)
        live &= (b != 32) & (b != 10)
    return key


def fixed(body: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as a binary column."""
    return column_of(np.full(len(body), body.shape[1]), body)


def rows_of(column: pa.Array, wide: int) -> np.ndarray:
    """A binary column of values of `wide` bytes as a matrix."""
    return bytes_of(column)[1].reshape(-1, wide)


def named_heads(keys: np.ndarray) -> pa.Array:
    """Heads as keys that are neither words nor phrases: a tab and their bytes."""
    body = np.full((len(keys), 2 * HEAD + 1), ord("\t"), np.uint8)
    body[:, 1:] = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - 2 * HEAD :]
    return fixed(body)


def numbered_heads(names: pa.Array) -> np.ndarray:
    body = np.zeros((len(names), 8), np.uint8)
    body[:, 8 - 2 * HEAD :] = rows_of(names, 2 * HEAD + 1)[:, 1:]
    return body.view(">u8").ravel().astype(np.uint64)


def first_heads(words: list[bytes]) -> np.ndarray:
    """The heads of `words`, each as the first of a text."""
    return numbered_heads(pa.array([b"\t" + START + (w + b" " if w else b"\n")[:HEAD].ljust(HEAD, b"\n") for w in words], pa.binary()))


def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    h = (h ^ (byte.astype(np.uint32) + np.uint32(1))) * np.uint32(0x9E3779B1)
    return h ^ h >> np.uint32(15)


def _begun(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, places of those to be told, item of each, hash of its word so far) of heads."""
    body = np.full((len(keys), 2 * HEAD + 1), 32, np.uint8)
    held = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - 2 * HEAD :]
    body[:, :HEAD], body[:, HEAD + 1 :] = held[:, :HEAD], held[:, HEAD:]
    told, far = np.ones((len(keys), HEAD), bool), np.full((len(keys), HEAD), 0xA5A5A5A5, np.uint32)
    for k in range(1, HEAD):
        b = held[:, HEAD + k - 1]
        told[:, k] = told[:, k - 1] & (b != 32) & (b != 10)
        far[:, k] = _step(far[:, k - 1], b)
    item, at = np.nonzero(told)
    return body.ravel(), item * (2 * HEAD + 1) + HEAD + 1 + at, item, far[told]


def _ended(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of words, whose bytes behind their heads are to be told."""
    buf = np.frombuffer(b" %b " % b"  ".join(words) if words else b"", np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    told = np.flatnonzero(np.arange(len(buf)) - start[word] > HEAD)
    h, far = np.full(len(words), 0xA5A5A5A5, np.uint32), np.empty(len(buf), np.uint32)
    by = np.argsort(-size, kind="stable")
    longer = len(by) - np.searchsorted(np.sort(size), np.arange(1, int(size.max(initial=1))), "right")
    first = start[by] + 1
    for t, live in enumerate(longer.tolist()):
        at = first[:live] + t
        far[at] = h[:live]
        h[:live] = _step(h[:live], buf[at])
    return buf, told, word[told], far[told]


def decisions(items: list[bytes] | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item number, node, bit, K x n slots) of every binary decision of words or of heads.

    Those of a word are the bytes behind its head, which no order sees the word before from; those
    of a head, given as a number, are its token's first bytes, in the running text before them."""
    with np.errstate(over="ignore"):
        buf, told, word, far = _begun(items) if isinstance(items, np.ndarray) else _ended(items)
        ctx = np.empty((K, len(told)), np.uint32)
        h = np.full(len(told), 0x51ED270B, np.uint32)
        for k in range(ORDERS[-1]):  # each order goes on from the one below
            h = _step(h, buf[told - k - 1])
            ctx[k] = h * np.uint32(0x85EBCA77)
        ctx[K - 1] = far
        buf = buf[told]
        n = LENGTH[buf]
        rep = np.repeat(np.arange(len(buf)), n)
        path = (OFF[buf] - (np.cumsum(n) - n))[rep] + np.arange(len(rep))
        mix = _PATH_MIX[path]
        slots = np.empty((K, len(rep)), np.int64)
        for k in range(K):
            x = ctx[k][rep]
            x ^= mix
            x *= np.uint32(0xC2B2AE3D)
            x ^= x >> np.uint32(14)
            x &= np.uint32(SLOTS - 1)
            slots[k] = x
    return word[rep], NODE[path], BIT[path], slots


def _groups(items: list[bytes] | np.ndarray, size: int = 1 << 14):
    """Ranges of words, or heads, with about `size` bytes in all."""
    ends = np.cumsum(np.full(len(items), HEAD) if isinstance(items, np.ndarray) else np.fromiter(map(len, items), np.int64, len(items)) + 1)
    at = 0
    while at < len(items):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield slice(at, to)
        at = to


def _columns(batches, size: int = 1 << 19):
    """(words or heads, occurrences) with `size` bytes or a little more in all, from batches of any size."""
    held, words, c = 0, [], []

    def out():
        word, n = pa.concat_arrays(words), np.concatenate(c)
        head = pc.starts_with(word, "\t")
        is_head = head.to_numpy(zero_copy_only=False)
        yield listed(word.filter(pc.invert(head))), n[~is_head]
        yield numbered_heads(word.filter(head)), n[is_head]

    for b in batches:
        if not b.num_rows:
            continue
        words.append(b.column("word"))
        held += pc.sum(pc.binary_length(words[-1])).as_py() + b.num_rows
        c.append(b.column("c").to_numpy())
        if held >= size:
            yield from out()
            held, words, c = 0, [], []
    if words:
        yield from out()


def _count(batches):
    total = np.zeros((K, SLOTS * 2), np.int64)
    for words, c in _columns(batches):
        for r in _groups(words):
            word, _, bit, slots = decisions(words[r])
            times = c[r][word]
            for k in range(K):
                np.add.at(total[k], slots[k] * 2 + bit, times)
    yield from chunks_of(total)


def _odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    n = n0 + n1
    back = np.float32(0.02) + np.float32(0.4) / (n + np.float32(1.5))
    st = np.clip(np.log((n1 + back) / (n0 + back)), -12, 12)
    st[n == 0] = 0
    return st.astype(np.float32)


def _level(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.int8) + (n > 2) + (n > 30)


def left_out(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, log-odds, level) by slot and bit: the counts as `evidence` takes a part away from them, and
    what it finds where one occurrence of the bit is taken away, as almost all are; levels of the gate's orders."""
    n = tables.reshape(K, SLOTS, 2).astype(np.float32)
    odds, level = np.empty((K, SLOTS, 2), np.float32), np.empty((2, SLOTS, 2), np.int8)
    for k in range(K):
        for bit in range(2):
            n0, n1 = (np.maximum(n[k, :, j] - np.float32(j == bit), 0) for j in range(2))
            odds[k, :, bit] = _odds(n0, n1)
            if k >= K - 2:
                level[k - K + 2, :, bit] = _level(n0 + n1)
    return n.reshape(K, -1), odds.reshape(K, -1), level.reshape(2, -1)


def evidence(left: tuple, slots: np.ndarray, bit: np.ndarray, own: np.ndarray | None = None):
    """(K x n log-odds of a 1, gate) of counted decisions, once each has taken its `own` occurrences, or one, away."""
    tables, odds, level = left
    st, gate = np.empty(slots.shape, np.float32), 0
    if own is None:
        for k in range(K):
            at = slots[k] * 2
            at += bit
            st[k] = odds[k][at]
            if k >= K - 2:
                gate = gate * LEVELS + level[k - K + 2][at].astype(np.int64)
        return st, gate
    own1 = (bit * own).astype(np.float32)
    own0 = own.astype(np.float32) - own1
    for k in range(K):
        at = slots[k] * 2
        n0, n1 = np.maximum(tables[k][at] - own0, 0), np.maximum(tables[k][at + 1] - own1, 0)
        st[k] = _odds(n0, n1)
        if k >= K - 2:
            gate = gate * LEVELS + _level(n0 + n1).astype(np.int64)
    return st, gate


def frozen(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, level) of every slot, so that scoring only looks them up."""
    n = tables.reshape(K, SLOTS, 2).astype(np.float32)
    return _odds(n[:, :, 0], n[:, :, 1]), _level(n.sum(2)).astype(np.int8)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def mixed(st: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(st.shape[1], np.float32)
    for k in range(K):
        out += st[k] * weights[:, k].astype(np.float32)[gate]
    return np.clip(out, -12, 12)


def _online(shared, batches):
    """Weights learned over one task's words by online Newton steps, block after block, and the
    decisions they saw by gate."""
    tables, weights = shared.value, np.full((GATES, K), 0.3)
    seen, curve = np.zeros(GATES), np.tile(np.eye(K), (GATES, 1, 1)) * 50.0
    for words, c in _columns(batches):
        for r in _groups(words, 1 << 13):
            word, _, bit, slots = decisions(words[r])
            st, gate = evidence(tables, slots, bit)
            p, times = _sigmoid(mixed(st, gate, weights)), c[r][word]
            err, bend = times * (bit - p), times * p * (1 - p)
            sizes = np.bincount(gate, minlength=GATES)
            seen += np.bincount(gate, weights=times, minlength=GATES)
            order = np.argsort(gate.astype(np.int8), kind="stable")  # each gate's decisions side by side
            st, err, bend = np.take(st, order, axis=1).astype(np.float64), err[order], bend[order]
            g, at = np.zeros((GATES, K)), 0
            for q, n in enumerate(sizes.tolist()):
                mine = st[:, at : at + n]
                g[q] = mine @ err[at : at + n]
                curve[q] += (mine * bend[at : at + n]) @ mine.T
                at += n
            step = np.linalg.solve(curve, g[:, :, None])[:, :, 0]
            weights += np.clip(step, -0.2, 0.2)
    yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "seen": [seen.tobytes()]})


def _apm_cell(node: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.minimum(node, APM_CTX - 1) * APM_BINS + np.rint((x + 12) * ((APM_BINS - 1) / 24)).astype(np.int64)


def _refine(shared, batches):
    tables, weights = shared.value
    total = np.zeros(APM_CTX * APM_BINS * 2, np.int64)
    for words, c in _columns(batches):
        for r in _groups(words):
            word, node, bit, slots = decisions(words[r])
            st, gate = evidence(tables, slots, bit)
            np.add.at(total, _apm_cell(node, mixed(st, gate, weights)) * 2 + bit, c[r][word])
    yield from chunks_of(total)


def train(words: DataFrame) -> tuple:
    """(frozen tables, their counts, weights, refinement) from `words` (word binary, c long).

    Its rows are the heads and the words of the training texts' running text, each with its
    occurrences: every decision of every text counts, and is learned from, as often as it occurs."""
    sc = words.sparkSession.sparkContext
    words = words.select("word", "c")
    tables = np.minimum(sum_arrays(words, _count, K * SLOTS * 2), 2**31 - 1).astype(np.uint32).reshape(K, -1)
    left = left_out(tables)
    shared = sc.broadcast(left)  # K * SLOTS * 17 bytes, whatever the corpus
    # one row of GATES x K numbers for each task, added up in groups before the driver sees them
    got = words.mapInArrow(lambda it: _online(shared, it), "weights binary, seen binary").repartition(8).mapInArrow(_add_weights, "weights binary, seen binary").collect()
    total, seen = np.zeros((GATES, K)), np.zeros(GATES)
    for r in got:
        total += np.frombuffer(r["weights"]).reshape(GATES, K)
        seen += np.frombuffer(r["seen"])
    weights = np.where(seen[:, None] > 0, total / np.maximum(seen, 1)[:, None], 0.3)
    both = sc.broadcast((left, weights))
    apm = sum_arrays(words, lambda it: _refine(both, it), APM_CTX * APM_BINS * 2).reshape(-1, 2).astype(np.float64)
    shared.destroy()
    both.destroy()
    centre = np.tile(_sigmoid((np.arange(APM_BINS) * (24 / (APM_BINS - 1))) - 12), APM_CTX)
    refinement = (apm[:, 1] + 20 * centre) / (apm.sum(1) + 20)
    return frozen(tables), left, weights.astype(np.float32), refinement.astype(np.float32)


def _add_weights(batches):
    total, seen = np.zeros((GATES, K)), np.zeros(GATES)
    for b in batches:
        for w, s in zip(b.column("weights").to_pylist(), b.column("seen").to_pylist(), strict=True):
            s = np.frombuffer(s)
            total, seen = total + np.frombuffer(w).reshape(GATES, K) * s[:, None], seen + s
    yield pa.RecordBatch.from_pydict({"weights": [total.tobytes()], "seen": [seen.tobytes()]})


def part_bits(words: list[bytes] | np.ndarray, model: tuple, own: np.ndarray | None = None) -> np.ndarray:
    """Bits that the model needs for heads or for what follows the heads of words; without their `own` occurrences."""
    if own is None:
        return _bits(words, model, None)
    out = np.empty(len(words))
    for some, less in ((own < 1, None), (own == 1, 1), (own > 1, own)):  # tables hold what none and one leave
        at = np.flatnonzero(some)
        if len(at):
            mine = words[at] if isinstance(words, np.ndarray) else [words[i] for i in at.tolist()]
            out[at] = _bits(mine, model, own[at] if less is own else less)
    return out


def _bits(words: list[bytes] | np.ndarray, model: tuple, own: np.ndarray | int | None) -> np.ndarray:
    """part_bits without no occurrences (None), without one of each (1) or without each one's `own`."""
    (odds, level), left, weights, refinement = model
    out, flip = np.zeros(len(words)), np.array([1, -1], np.float32)
    refined = np.concatenate([1 - refinement, refinement])  # by the bit, of a 0 first
    for r in _groups(words):
        word, node, bit, slots = decisions(words[r])
        if own is not None:
            st, gate = evidence(left, slots, bit, own[r][word] if isinstance(own, np.ndarray) else None)
        else:
            gate = level[K - 2][slots[K - 2]].astype(np.int64) * LEVELS + level[K - 1][slots[K - 1]]
            st = [odds[k][slots[k]] for k in range(K)]
        x = np.zeros(len(word), np.float32)
        for k in range(K):
            x += st[k] * weights[:, k][gate]
        np.clip(x, -12, 12, out=x)
        p = 1 / (1 + np.exp(x * flip[bit]))
        cell = refined[_apm_cell(node, x) + bit * len(refinement)]
        bits = -np.log2(0.5 * p + 0.5 * cell).astype(np.float64)
        out[r] = np.bincount(word, weights=bits, minlength=r.stop - r.start)
    return out


def word_bits(words: list[bytes], model: tuple, without: bool = False) -> np.ndarray:
    """Bits of each of `words` with its end mark, as the first of a text; `without` one occurrence of it."""
    own = np.ones(len(words), np.int64) if without else None
    return part_bits(first_heads(words), model, own) + part_bits(words, model, own)


_REMEMBERED: dict = {"model": None, "bits": {}, "heads": np.zeros(0, np.uint64), "head_bits": np.zeros(0)}


def _forget(key: object) -> None:
    if _REMEMBERED["model"] != key:
        _REMEMBERED.update(model=key, bits={}, heads=np.zeros(0, np.uint64), head_bits=np.zeros(0))


def remembered_bits(words: list[bytes], c: np.ndarray, key: object, model: tuple) -> np.ndarray:
    """part_bits, keeping a bounded number of frequent words from one block to the next."""
    _forget(key)
    known = _REMEMBERED["bits"]
    out = np.fromiter(map(known.get, words, repeat(np.nan)), np.float64, len(words))
    new = np.flatnonzero(np.isnan(out))
    if len(new):
        out[new] = part_bits([words[i] for i in new], model)
        for i in new[c[new] >= 8][: max(0, (1 << 17) - len(known))]:
            known[words[i]] = out[i]
    return out


def begun_bits(keys: np.ndarray, own: np.ndarray, key: object, model: tuple) -> np.ndarray:
    """part_bits of heads without their `own` occurrences, keeping a bounded number of them."""
    _forget(key)
    kinds, at = np.unique(keys, return_inverse=True)
    wide = int(own.max(initial=0)) + 1
    pair, back = np.unique(at * wide + own, return_inverse=True)
    kinds, own = kinds[pair // wide], pair % wide
    few = own < 1 << 16  # with 48 bits of the head, what is left of 64
    names = kinds << np.uint64(16) | np.where(few, own, 0).astype(np.uint64)
    known = _REMEMBERED["heads"]
    place = np.searchsorted(known, names)
    hit = few & (np.append(known, 0)[place] == names) & (place < len(known))
    out = np.empty(len(names))
    out[hit] = _REMEMBERED["head_bits"][place[hit]]
    new = np.flatnonzero(~hit)
    out[new] = part_bits(kinds[new], model, own[new])
    new = new[few[new]]
    if len(known) + len(new) > HEADS_KEPT:
        _REMEMBERED.update(heads=names[new], head_bits=out[new])
    else:
        _REMEMBERED.update(heads=np.insert(known, place[new], names[new]), head_bits=np.insert(_REMEMBERED["head_bits"], place[new], out[new]))
    return out[back]


def counted(c: np.ndarray, bits: np.ndarray, totals: tuple) -> np.ndarray:
    """Bits of words (or phrases) that were met `c` times and whose parts cost `bits`: the count,
    less a discount, and beside it the parts, which share what the counts gave up."""
    total, kinds, n1, n2 = totals
    if not total:
        return bits
    less = max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05)
    with np.errstate(divide="ignore"):
        return -np.logaddexp2(np.log2(np.maximum(c - less, 0) / total), np.log2(less * kinds / total) - bits)


def shared_bits(tokens: np.ndarray, parts: np.ndarray, share: float) -> np.ndarray:
    """Bits where the mixed bits' probability has its `share` beside that of the counts."""
    if share in (0, 1):
        return parts if share else tokens
    return tokens - np.log2(1 - share + share * np.exp2(tokens - parts))


def _numbered(batches):
    """`batches` with the block of every row: so many bytes of text of one partition, one after another."""
    k, held = 0, 0
    for b in batches:
        # by the partition of the input, as a union counts tasks anew
        base = b.column("part")[0].as_py() << 32 if b.num_rows else 0
        size = [len(x or b"") for x in b.column("text").cast(pa.binary()).to_pylist()]
        blk = np.empty(len(size), np.int64)
        for i, n in enumerate(size):
            if held and held + n > BLOCK:
                k, held = k + 1, 0
            held += n + 1
            blk[i] = base + k
        yield b.drop_columns(["part"]).add_column(0, "blk", pa.array(blk))


def _runs(*columns: np.ndarray):
    """Ranges of equal neighbours."""
    n = len(columns[0])
    cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    return zip([0, *cut.tolist()], [*cut.tolist(), n], strict=True) if n else ()


def _block_words(batches, heads: bool = False):
    """(blk, word, n): every word and phrase of a block with its count in the block's training texts; if
    asked for also heads with theirs, in as few rows as memory allows, each in one row of a block at most."""
    blk, vocabulary, counts, held, begun = None, Vocabulary(), np.zeros(0, np.int64), [], []

    def rows(column: pa.Array, n: np.ndarray):
        for i in range(0, len(column), 50_000):
            part = column.slice(i, 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), blk)), part, pa.array(n[i : i + 50_000])], names=["blk", "word", "n"])

    def out(last: bool = False):
        yield from rows(pa.array(list(vocabulary.at), pa.binary()), counts[: len(vocabulary.at)])
        keys, learn = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, learn = keys[order], learn[order]
        first = np.flatnonzero(np.append(True, np.any(keys[1:] != keys[:-1], axis=1)))
        body = np.full((len(first), 17), ord(" "), np.uint8)
        body[:, 1:] = keys[first].view(np.uint8).reshape(-1, 16)
        yield from rows(fixed(body), np.add.reduceat(learn.astype(np.int64), first))
        if heads:
            begun[:] = [summed(begun)]
            if last or len(begun[0][0]) > HEADS_KEPT:
                yield from rows(named_heads(begun[0][0]), begun[0][1])
                begun.clear()

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)

    for b in batches:
        blks = b.column("blk").to_numpy()
        learn, texts = b.column("learn").to_numpy(zero_copy_only=False), [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
        for lo, hi in _runs(blks):
            if blks[lo] != blk:
                if blk is not None:
                    yield from out()
                blk, vocabulary, counts, held = int(blks[lo]), Vocabulary(), np.zeros(0, np.int64), []
            for i, j in slices(texts[lo:hi]):
                words, size = tokens_of(texts[lo + i : lo + j])
                ids, known = vocabulary.add(words), np.repeat(learn[lo + i : lo + j], size)
                counts = np.append(counts, np.zeros(len(vocabulary.at) - len(counts), np.int64)) + np.bincount(ids[known], minlength=len(vocabulary.at))
                starts, keys = vocabulary.phrases(ids)
                held.append((keys.T.astype("<u8"), known[starts]))
                if heads:
                    begun.append(summed([(heads_of(words, size)[known], np.ones(np.count_nonzero(known), np.int64))]))
    if blk is not None:
        yield from out(True)


def _own(doc: np.ndarray, item: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, occurrences) of the distinct pairs, and the pair of every entry."""
    pair, at, n = np.unique(doc * n_items + item, return_inverse=True, return_counts=True)
    return pair // n_items, pair % n_items, n, at


class _Block:
    """The words and phrases of one block with their counts in all training texts.

    A word is scored in the `running` text, or else as the first of a text."""

    def __init__(self, words: list[bytes], c: np.ndarray, phrases: np.ndarray, n: np.ndarray, key: str, model: tuple, totals: list, running: bool):
        self.words, self.c, self.key, self.model, self.totals, self.running = words, c.astype(np.float64), key, model, totals, running
        self.vocabulary = Vocabulary()
        self.vocabulary.add(words)
        total, kinds, *_ = totals[0]
        self.base = np.log10((self.c + 0.1) / (total + 0.1 * (kinds + 1)))
        order = np.argsort(phrases)
        self.phrases, self.n = phrases[order], n[order].astype(np.float64)
        self.bits = np.full((2, len(words)), np.nan)
        self.starts = None if running else first_heads(words)

    def word_costs(self, ids: np.ndarray, without: np.ndarray) -> np.ndarray:
        """Bits of words behind their heads; of those that no other document has, `without` their occurrences."""
        for k in range(2):
            want = np.zeros(len(self.words), bool)
            want[ids[without == k]] = True
            want = np.flatnonzero(want & np.isnan(self.bits[k]))
            if len(want):
                ws = [self.words[i] for i in want.tolist()]
                own = self.c[want] if self.running else np.ones(len(want))
                self.bits[k, want] = part_bits(ws, self.model, own) if k else remembered_bits(ws, self.c[want], self.key, self.model)
        return self.bits[without.astype(np.int64), ids]

    def score(self, texts: list[bytes], learn: np.ndarray) -> list[np.ndarray]:
        """tokens, known ones, base score, bits of every text; learned ones without their own part of the counts."""
        words, size = tokens_of(texts)
        ids = self.vocabulary.ids(words)
        doc = np.repeat(np.arange(len(texts)), size)
        first = np.cumsum(size) - size
        d, item, n, at = _own(doc, ids, len(self.words))
        c = self.c[item] - np.where(learn[d], n, 0)
        without = learn[d] & (c <= 0)
        parts, met = self.word_costs(item, without)[at], np.maximum(c, 0)[at]
        if self.running:
            heads, place = np.unique(heads_of(words, size), return_inverse=True)
            d, item, n, at = _own(doc, place, len(heads))
            parts = parts + begun_bits(heads[item], np.where(learn[d], n, 0), self.key, self.model)[at]
        else:
            parts = parts + begun_bits(self.starts[ids], without[at].astype(np.int64), self.key, self.model)
        tokens = counted(met, parts, self.totals[0])
        starts, keys = self.vocabulary.phrases(ids)
        place = np.searchsorted(self.phrases, keys[0])
        d, item, n, at = _own(doc[starts], place, len(self.phrases))
        c = np.maximum(self.n[item] - np.where(learn[d], n, 0), 0)[at]
        shares = SHARES if self.running else SHARES[:1]
        total = np.empty((len(shares), len(texts)))
        for k, share in enumerate(shares):
            bits = np.add.reduceat(shared_bits(tokens, parts, share), starts)
            total[k] = np.bincount(doc[starts], weights=counted(c, bits, self.totals[1]), minlength=len(texts))
        total = np.log2(len(shares)) - np.logaddexp2.reduce(-total, axis=0)
        return [size, np.add.reduceat((self.c[ids] > 0).astype(np.int64), first), np.add.reduceat(self.base[ids], first), total]


def _scored(shared, key: str, totals: list, running: bool = False):
    def run(batches):
        blk, block, held = None, None, {0: [], 1: []}
        for b in batches:
            blks, kinds = b.column("blk").to_numpy(), b.column("kind").to_numpy()
            for lo, hi in _runs(blks, kinds):
                if blks[lo] != blk:
                    blk, block, held = int(blks[lo]), None, {0: [], 1: []}
                part = b.slice(lo, hi - lo)
                if kinds[lo] < 2:
                    names = part.column("word")
                    names = [rows_of(names, 17)[:, 1:9].tobytes()] if kinds[lo] else listed(names)
                    held[int(kinds[lo])].append((names, part.column("c").to_numpy().copy()))
                    continue
                if block is None:
                    (ws, c), (ps, n) = (([w for x in held[k] for w in x[0]], np.concatenate([x[1] for x in held[k]])) for k in (0, 1))
                    block, held = _Block(ws, c, np.frombuffer(b"".join(ps), "<u8"), n, key, shared.value, totals, running), {0: [], 1: []}
                    del ws, ps
                texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                learn = part.column("learn").to_numpy(zero_copy_only=False)
                got = [block.score(texts[i:j], learn[i:j]) for i, j in slices(texts)]
                size, known, base, bits = (np.concatenate(x) for x in zip(*got, strict=True))
                length = np.array([len(t) for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(size), pa.array(known), pa.array(np.full(len(texts), totals[0][0])), pa.array(base), pa.array(-bits * np.log10(2.0)), pa.array(bits / np.maximum(length + 1, 1))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
                )

    return run


def score(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    Learns from rows whose crc32 modulo `folds` is not `held`. Rows are read twice and must come
    in the same order in the same partitions, as those of files do; write other inputs first."""
    spark = docs.sparkSession
    small_batches(spark, 8000, 4 << 20)  # most rows are words; their batches cost by number
    rest = fold(F.col("doc_id"), folds)
    d = docs.select("doc_id", "text", F.coalesce(rest == held, F.lit(False)).alias("held_out"), F.coalesce(rest != held, F.lit(False)).alias("learn"), F.spark_partition_id().alias("part"))
    found = d.select("learn", "text", "part").mapInArrow(lambda it: _block_words(_numbered(it), True), "blk long, word binary, n long")
    d = d.mapInArrow(_numbered, "blk long, doc_id long, text string, held_out boolean, learn boolean")
    every = Window.partitionBy("word")
    kind = F.when(F.col("word").startswith(F.lit(b" ")), 1).when(F.col("word").startswith(F.lit(b"\t")), -1).otherwise(0)
    found = found.select("blk", "word", kind.alias("kind"), F.sum("n").over(every).alias("c"), (F.min("blk").over(every) == F.col("blk")).alias("once"))
    j = materialise(found.where("once or kind >= 0"), "words")  # heads are only learned from
    once = j.where("once and c > 0")
    got = {r[0]: tuple(r[1:]) for r in once.groupBy("kind").agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).collect()}
    totals = [got.get(k, (0, 0, 0, 0)) for k in (0, 1)]
    model = spark.sparkContext.broadcast(train(once.where("kind < 1")))  # K * SLOTS * 22 bytes, whatever the corpus
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    words = j.where("kind >= 0").select("blk", "kind", "word", "c")
    both = words.unionByName(d.select("blk", F.lit(2).alias("kind"), "doc_id", "text", "held_out", "learn"), allowMissingColumns=True)
    return both.repartition(F.col("blk")).sortWithinPartitions("blk", "kind").mapInArrow(_scored(model, uuid.uuid4().hex, totals, True), schema)


def op2_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
