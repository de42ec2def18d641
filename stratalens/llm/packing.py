"""Vector best-fit packing of token sequences.

A piece of ``l`` tokens asks for the vector (l tokens, 1 document, l*l attention cost); a bin has a
capacity for each.  The demand depends on the length alone, so the whole corpus is described by a
histogram of at most ``max_tokens`` lengths.  The driver packs that histogram, longest first: the
open bins are kept as runs of equal bins (the same residual vector), each length goes to the feasible
run with the best score, and a run takes as many pieces at once as item-by-item best fit would give
it.  The plan has a few thousand entries however large the corpus is, and its result is what best fit
over all pieces in one process would give, so nothing is lost at partition borders.

Every piece then finds its place from its rank among the pieces of its length.  Ranks are counted
inside the tasks that make the pieces and shifted by a running sum over (length, task).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise, ship_package
from .tokens import encode_in_blocks, settle

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


@dataclass(frozen=True)
class Capacity:
    """Limits of a bin.  ``attention`` bounds the sum of squared piece lengths."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    #: "norm": least weighted residual norm after placing; "dot": largest weighted demand-residual product.
    score: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.int64)


@dataclass
class Plan:
    """Rows (length, first rank, first bin, pieces per bin, first offset), for look-up by rank."""

    rows: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    bins: int = 0


def demand(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], dtype=np.int64)


def _scores(residual: np.ndarray, want: np.ndarray, cap: np.ndarray, c: Capacity) -> np.ndarray:
    """Lower is better."""
    w = np.asarray(c.weights)
    if c.score == "dot":
        return -((residual / cap) * (want / cap) * w).sum(axis=-1)
    return (w * ((residual - want) / cap) ** 2).sum(axis=-1)


def plan_bins(histogram: dict[int, int], c: Capacity) -> Plan:
    """Pack ``histogram[length]`` pieces of each length, longest first.

    A length that no empty bin can hold under every constraint is an error.
    """
    cap, plan = c.vector(), Plan()
    residual = np.zeros((1024, 3), dtype=np.int64)
    first, count = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
    used = 0
    for length in sorted(histogram, reverse=True):
        left, rank, want = histogram[length], 0, demand(length)
        rows = plan.rows.setdefault(length, [])
        if (want > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no empty bin")
        while left > 0:
            live = np.flatnonzero((count[:used] > 0) & (residual[:used] >= want).all(axis=1))
            score = _scores(residual[live], want, cap, c) if len(live) else np.zeros(0)
            if len(live):
                at = int(np.argmin(score))  # ties: the oldest run
                run, state, best_other = int(live[at]), residual[live[at]].copy(), np.delete(score, at)
                rest = best_other.min() if len(best_other) else np.inf
                have, begin = int(count[run]), int(first[run])
                same = _scores(state, want, cap, c)
            else:
                run, state, have, begin, rest, same = -1, cap.copy(), left, plan.bins, np.inf, np.inf
            depth = 1  # pieces of this length that best fit puts into one bin in a row
            while depth < left:
                after = state - depth * want
                if (after < want).any():
                    break
                s = _scores(after, want, cap, c)
                if s > min(rest, same) or (run < 0 and len(live)):
                    break
                depth += 1
            bins = min(have, left // depth) if left >= depth else 0
            if bins == 0:
                bins, depth = 1, min(depth, left)
            offset = int(cap[0] - state[0])
            rows.append((rank, begin, depth, offset))
            if run < 0:
                plan.bins += bins
            else:
                first[run] += bins
                count[run] -= bins
            if used == len(first):
                keep = np.flatnonzero(count[:used] > 0)
                size = max(1024, 2 * len(keep))
                residual, first, count = (np.concatenate([x[keep], np.zeros((size - len(keep), *x.shape[1:]), dtype=np.int64)]) for x in (residual, first, count))
                used = len(keep)
            residual[used], first[used], count[used] = state - depth * want, begin, bins
            used += 1
            rank += bins * depth
            left -= bins * depth
    return plan


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, max_tokens: int) -> DataFrame:
    """One row per piece of each document: its ids then ``end_id``, cut so that only the first piece is short.

    Columns: doc_id, piece, start, length, ids_crc32, and (task, rank): the making task and the count of
    earlier pieces of the same length in it.  Null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(max_tokens + 1, dtype=np.int64)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), encode_in_blocks(b.column(1).to_pylist(), tokenizer_path), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % max_tokens or max_tokens, n + 1, max_tokens)]
                for k in range(len(cuts) - 1):
                    size = cuts[k + 1] - cuts[k]
                    out.append((doc, k, cuts[k], size, zlib.crc32(ids[4 * cuts[k] : 4 * cuts[k + 1]]), task, int(seen[size])))
                    seen[size] += 1
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])
        settle()

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: Capacity = Capacity()) -> DataFrame:
    """Pack all documents into bins: the pieces with ``sequence_id`` and ``offset`` in the bin.

    Null text: empty, so a piece of the end id alone.  Rows that repeat are packed once each.  An empty
    table gives no rows.  Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    pieces = materialise(token_pieces(docs, tokenizer_path, end_id, capacity.tokens), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = per_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_bins(histogram, capacity)
    table = {k: np.array(v, dtype=np.int64) for k, v in plan.rows.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("base").to_numpy()
            seq, off = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                size = int(length[rows[0]])
                t = table[size]
                r = rank[rows]
                at = np.searchsorted(t[:, 0], r, side="right") - 1
                inside = r - t[at, 0]
                seq[rows] = t[at, 1] + inside // t[at, 2]
                off[rows] = t[at, 3] + inside % t[at, 2] * size
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.join(bases, ["length", "task"]).mapInArrow(place, schema)
