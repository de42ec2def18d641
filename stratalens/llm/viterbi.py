"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton enumerates all vocabulary matches by end position, longest first; dynamic
programming carries the best score and the piece count to each position.  A later match replaces an
equal score never, so that of equally good segmentations the one whose last piece is longer wins at
every position, which is the tokenizers' own rule.  A character that is no piece of its own is unknown:
it scores the least piece score minus 10 and counts as its UTF-8 bytes (byte fallback) or, fused with
unknown neighbours, as one.

No piece holds the blank mark after another character and all scores are whole numbers, so that sums are
exact; then a text falls apart at its blanks and each distinct chunk is segmented once per worker.  For
other vocabularies whole texts are segmented.

The scores of a BPE file are read as unigram scores, so its counts are not those of BPE merging.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import ship_package

MARK = "▁"
_PENALTY = 10.0
#: Bytes (estimated) of counted chunks that a worker keeps; longer chunks than the second are not kept.
_MAX_BYTES, _LONGEST_KEY = 100_000_000, 256
_CHUNKS = re.compile(" *[^ ]+| +")


@dataclass(frozen=True)
class Unigrams:
    """Pieces with scores.  ``add_prefix``: a blank mark is put before a text that does not begin with one."""

    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool = True
    add_prefix: bool = True

    @property
    def by_chunk(self) -> bool:
        names = {p for p, _ in self.pieces}
        return self.add_prefix and MARK in names and all(float(s).is_integer() for _, s in self.pieces) and not any(MARK in p.lstrip(MARK) for p in names)


def load_unigrams(path: str) -> Unigrams:
    """The ordinary pieces of a SentencePiece model file, with their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return Unigrams(tuple((m.id_to_piece(i), float(m.get_score(i))) for i in ids), byte_fallback=any(m.is_byte(i) for i in range(m.vocab_size())))


class Counter:
    """Counts and scores texts with a vocabulary; built once per worker."""

    def __init__(self, vocabulary: Unigrams) -> None:
        import ahocorasick

        self.v, self.auto = vocabulary, ahocorasick.Automaton()
        for piece, score in dict(vocabulary.pieces).items():
            self.auto.add_word(piece, (len(piece), float(score)))
        if len(self.auto):
            self.auto.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - _PENALTY
        self.by_chunk = vocabulary.by_chunk
        self.counts: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.held = 0

    def segment(self, text: str) -> tuple[int, float]:
        """Piece count and best score of a text whose blanks are marks already."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count, fused = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        done, fallback = 0, self.v.byte_fallback

        def step(end: int) -> None:
            """Enter the unknown character before ``end`` (only where no piece of one character ended)."""
            score = best[end - 1] + self.unknown
            if best[end] is None or score > best[end]:
                best[end] = score
                if fallback:
                    count[end] = count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    count[end] = count[end - 1] + (not fused[end - 1])
                fused[end] = True

        single = True  # position ``done`` needs no unknown step
        for last, (length, score) in self.auto.iter(text) if len(self.auto) else ():
            end = last + 1
            if end != done:
                if not single:
                    step(done)
                for k in range(done + 1, end):
                    step(k)
                done, single = end, False
            start = end - length
            score += best[start]
            if best[end] is None or score > best[end]:
                best[end], count[end], fused[end] = score, count[start] + 1, False
            if length == 1:
                single = True
        if not single:
            step(done)
        for k in range(done + 1, n + 1):
            step(k)
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        """Piece count and best score of a raw text; (0, 0.0) for an empty one."""
        if not text:
            return 0, 0.0
        if not self.by_chunk:
            marked = text.replace(" ", MARK)
            return self.segment(marked if marked[0] == MARK or not self.v.add_prefix else MARK + marked)
        chunks = text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text else None
        if chunks is None:
            chunks = ["\0" + c for c in _CHUNKS.findall(text.replace(MARK, " ") if text[0] in (" ", MARK) else " " + text.replace(MARK, " "))]
        try:
            return sum(map(self.counts.__getitem__, chunks)), sum(map(self.scores.__getitem__, chunks))
        except KeyError:
            if self.held > _MAX_BYTES:
                self.counts.clear()
                self.scores.clear()
                self.held = 0
            long = []
            for c in set(chunks):
                if c not in self.counts:
                    self.counts[c], self.scores[c] = self.segment(c[1:].replace(" ", MARK) if c[:1] == "\0" else MARK + c)
                    if len(c) > _LONGEST_KEY:
                        long.append(c)
                    else:
                        self.held += len(c) + 200
            found = sum(map(self.counts.__getitem__, chunks)), sum(map(self.scores.__getitem__, chunks))
            for c in long:
                del self.counts[c], self.scores[c]
            return found


_held: dict[Unigrams, Counter] = {}


def counter(v: Unigrams) -> Counter:
    if v not in _held:
        _held.clear()
        _held[v] = Counter(v)
    return _held[v]


def count_tokens(docs: DataFrame, vocabulary: Unigrams) -> DataFrame:
    """doc_id, n_tokens and best_score of every whole text, without building a token.

    Null and empty texts have 0 tokens and score 0.  Rows are mapped one to one; other columns are left out.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(shared.value)
        for b in batches:
            found = [c.count(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "best_score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, best_score double")
