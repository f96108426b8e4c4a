"""Token counts under a unigram vocabulary, without building the tokens.

Spaces become the mark U+2581, one stands before the text, and the text splits before every
run of marks, which no piece crosses; each part is segmented alone. An Aho-Corasick automaton lists, for every end position,
the pieces that end there, longest first. Dynamic programming keeps the best score of each
prefix and, along its best path, the number of pieces. Ties go to the longer last piece. A
character that is no piece by itself may also be unknown, at the least score less 10, and
counts as the byte pieces of its UTF-8 form. A Counter without byte pieces, as for
vocabularies that have none, takes neighbouring unknown characters as one piece and splits
before every mark.

A part's count depends on its characters alone, so a worker remembers parts up to a bound.

Defined cases: a null or empty text has no pieces and score 0; repeated rows count alike; a
null doc_id keeps its null; an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 1 << 18
_RUN = re.compile(f"{MARK}+[^{MARK}]*")


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a piece-model file, without control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    use = (i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))
    return [(m.id_to_piece(i), m.get_score(i)) for i in use]


def has_byte_pieces(path: str) -> bool:
    """Whether a piece-model file has a piece for every byte."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return sum(m.is_byte(i) for i in range(m.get_piece_size())) == 256


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool = False):
        import ahocorasick

        # a piece that goes on after a mark within it would be lost to the split
        if byte_pieces and any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece has a mark after another character")
        self.byte_pieces = byte_pieces
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.empty = not any(p for p, _ in pieces)
        self.new: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def part(self, w: str) -> tuple[int, float]:
        """(pieces, score) of one part, uncut."""
        n = len(w)
        best: list = [0.0] + [None] * n
        count, odd, single = [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        unknown, done, by_bytes = self.unknown, 0, self.byte_pieces

        def settle(to: int) -> None:
            nonlocal done
            while done < to:
                done += 1
                if not single[done]:
                    c = best[done - 1] + unknown
                    if best[done] is None or c > best[done]:
                        best[done], odd[done] = c, True
                        count[done] = count[done - 1] + (len(w[done - 1].encode()) if by_bytes else not odd[done - 1])

        for last, (size, score) in () if self.empty else self.automaton.iter(w):
            e = last + 1
            if done < last:
                settle(last)
            s = e - size
            c = best[s] + score
            if best[e] is None or c > best[e]:
                best[e], count[e], odd[e] = c, count[s] + 1, False
            if size == 1:
                single[e] = True
        settle(n)
        return count[n], best[n]

    def _find(self, w: str) -> tuple[int, float]:
        got = self.old.get(w) or self.part(w if self.byte_pieces else MARK + w)
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        self.new[w] = got
        return got

    def text(self, t: str | None) -> tuple[int, float]:
        if not t:
            return 0, 0.0
        t = t.replace(" ", MARK)
        n, score, new = 0, 0.0, self.new
        t = t[1:] if t[0] == MARK else t
        for w in _RUN.findall(MARK + t) if self.byte_pieces else t.split(MARK):
            got = new.get(w)
            if got is None:
                got = self._find(w)
                new = self.new
            n += got[0]
            score += got[1]
        return n, score


def count(docs: DataFrame, pieces: list[tuple[str, float]], byte_pieces: bool = False) -> DataFrame:
    """doc_id, n_pieces and the best segmentation's score of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # of the vocabulary's size

    def run(batches):
        counter = Counter(shared.value, byte_pieces)
        for b in batches:
            got = [counter.text(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_pieces": pa.array([x[0] for x in got], pa.int64()), "score": pa.array([x[1] for x in got], pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, score double")


def op7_tokencount(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    return count(table(spark, sf_dir, "documents"), load_pieces(path), has_byte_pieces(path))
