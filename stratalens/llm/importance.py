"""Importance resampling of documents towards a target corpus, by hashed word features.

Features are all runs of one and two consecutive words (A-Z lower-cased; ASCII letters and digits and all
other characters beyond ASCII make words), repeats counted; the bucket of a feature is the crc32 of its
UTF-8 bytes modulo ``buckets``.

The work is an external sort-count in three passes:

1. each task writes packed streams of uint16 buckets with the places where its documents begin;
2. each stream is sorted and run-length encoded; a task adds its runs and hands on at most ``buckets`` sums;
3. the gain of each bucket, from at most ``buckets`` sums of each side, is gathered along the streams and
   summed per document with ``np.add.reduceat``.

A document stays whole in one stream row, which is smaller than its text.  Ranks come from a written table
that is range-partitioned by the order of the draw: a row's place in its partition, shifted by the sizes of
the partitions before it.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, ship_package, trim
from .textscan import LOWER

#: Bytes of text whose words are hashed together, and the longest word that is hashed in step with others.
_BLOCK, _LONG = 1 << 20, 63

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def _shift_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For n zero bytes: where each byte of a register goes, the start register, and one that has read a blank.

    The register is linear: reading bytes from register r gives the register of r after as many zero bytes,
    xor that of the bytes read from zero.
    """
    moved = np.zeros((_LONG + 2, 4, 256), dtype=np.uint32)
    moved[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(1, _LONG + 2):
        moved[n] = _CRC[moved[n - 1] & 255] ^ (moved[n - 1] >> 8)

    def run(register: int) -> np.ndarray:
        out = np.zeros(_LONG + 1, dtype=np.uint32)
        out[0] = register
        for n in range(1, _LONG + 1):
            out[n] = _CRC[out[n - 1] & 255] ^ (out[n - 1] >> 8)
        return out

    return moved, run(0xFFFFFFFF), run(int(_CRC[32]))


_MOVED, _START, _BLANK = _shift_tables()


def _pair_registers(first: np.ndarray, zero: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The registers of "first second" from the register of the first word and what the second gives from zero."""
    far = size + 1
    out = zero ^ _BLANK[size]
    for k in range(4):
        out ^= _MOVED[far, k, (first >> np.uint32(8 * k)) & 255]
    return out


def _block_buckets(a: np.ndarray, begins: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, tuple[bytes, int] | None]:
    """Buckets of all features of the documents in ``a`` (lower-cased, a blank between them) and where each document's begin.

    Also the first word and the crc32 of the last one, None without words.
    """
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[a]
    step = np.diff(inside)
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    n = len(start)
    first_word = np.searchsorted(start, begins)
    paired = np.ones(n, dtype=bool)
    paired[first_word[first_word < n]] = False
    slot = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(1 + paired, out=slot[1:])
    if not n:
        return np.zeros(0, dtype=np.uint16), slot[first_word], None
    size = stop - start
    short = np.minimum(size, _LONG)
    order = np.argsort(-short, kind="stable")
    at, left = start[order], short[order]
    zero = np.zeros(n, dtype=np.uint32)
    live = np.searchsorted(-left, -np.arange(left[0]), side="left")  # words longer than each place
    for k in range(int(left[0])):
        m = int(live[k])
        r = zero[:m]
        zero[:m] = _CRC[(r ^ a[at[:m] + k]) & 255] ^ (r >> 8)
    by_word = np.empty(n, dtype=np.uint32)
    by_word[order] = zero
    register = by_word ^ _START[short]
    pair = np.zeros(n, dtype=np.uint32)
    two = np.flatnonzero(paired)
    pair[two] = _pair_registers(register[two - 1], by_word[two], short[two])
    full = np.uint32(0xFFFFFFFF)
    one_crc, two_crc = register ^ full, pair ^ full
    for i in np.flatnonzero(size > _LONG).tolist():
        one_crc[i] = zlib.crc32(a[start[i] : stop[i]])
    for i in np.flatnonzero((size > _LONG) | np.concatenate([[False], size[:-1] > _LONG])).tolist():
        if paired[i]:
            two_crc[i] = zlib.crc32(a[start[i] : stop[i]], zlib.crc32(b" ", int(one_crc[i - 1])))
    out = np.empty(slot[-1], dtype=np.uint16)
    out[slot[:-1]] = one_crc % np.uint32(buckets)
    out[slot[two] + 1] = two_crc[two] % np.uint32(buckets)
    return out, slot[first_word], (a[start[0] : stop[0]].tobytes(), int(one_crc[-1]))


def _long_text(text: bytes, buckets: int) -> np.ndarray:
    """All buckets of one long text, read in pieces that end behind a word; the pair across a cut is added."""
    whole, parts, at, before = np.frombuffer(text, dtype=np.uint8), [], 0, None
    while at < len(text):
        end = min(len(text), at + _BLOCK)
        while end < len(text) and _WORD[whole[end]]:
            end += 1
        found, _, ends = _block_buckets(LOWER[whole[at:end]], np.zeros(1, dtype=np.int64), buckets)
        parts.append(found)
        if ends is not None:
            if before is not None:
                parts.append(np.array([zlib.crc32(b" " + ends[0], before) % buckets], dtype=np.uint16))
            before = ends[1]
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint16)


def streams(texts: list[bytes | None], buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, begins, stream): the buckets of ``texts[first:last]`` and where each text's begin."""
    first, size = 0, 0

    def packed(lo: int, hi: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        lengths = [len(t or b"") + 1 for t in texts[lo:hi]]
        begins = np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(np.int64)
        stream, at, _ = _block_buckets(LOWER[np.frombuffer(b" ".join(t or b"" for t in texts[lo:hi]), dtype=np.uint8)], begins, buckets)
        return lo, hi, at, stream

    for k, t in enumerate(texts):
        if t is not None and len(t) > _BLOCK:
            if k > first:
                yield packed(first, k)
            yield k, k + 1, np.zeros(1, dtype=np.int64), _long_text(t, buckets)
            first, size = k + 1, 0
            continue
        size += len(t or b"") + 1
        if size > _BLOCK:
            yield packed(first, k + 1)
            first, size = k + 1, 0
    if first < len(texts):
        yield packed(first, len(texts))


_STREAMS = "docs array<long>, begins array<long>, stream binary"


def bucket_streams(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of whole documents: their ids, where the features of each begin, and the packed uint16 buckets."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, begins, stream in streams(b.column(1).cast(pa.binary()).to_pylist(), buckets):
                cols = [pa.array([ids[lo:hi]], pa.list_(pa.int64())), pa.array([begins.tolist()], pa.list_(pa.int64())), pa.array([stream.astype("<u2").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["docs", "begins", "stream"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, _STREAMS)


def bucket_counts(packed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): every stream is sorted and run-length encoded; a task hands on the sums of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for raw in b.column("stream"):
                s = np.sort(np.frombuffer(raw.as_buffer(), dtype="<u2"), kind="stable")  # a radix sort
                if len(s):
                    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                    total[s[head]] += np.diff(head, append=len(s))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return packed.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: dict[int, int], wanted: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket in the target and in the corpus, floored."""
    s_all, t_all = float(sum(own.values()) + buckets), float(sum(wanted.values()) + buckets)
    return np.array([math.floor(1000 * math.log((wanted.get(k, 0) + 1.0) * s_all / ((own.get(k, 0) + 1.0) * t_all))) for k in range(buckets)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the identifier (null: empty) and the seed alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(packed: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_features, weight (floored mean gain, 0 without features) and score (weight plus noise)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, begins, raw in zip(b.column("docs"), b.column("begins"), b.column("stream"), strict=True):
                at = begins.values.to_numpy()
                s = np.frombuffer(raw.as_buffer(), dtype="<u2")
                n = np.diff(at, append=len(s))
                some = np.flatnonzero(n)
                weight = np.zeros(len(at), dtype=np.int64)
                if len(some):  # reduceat wants no empty segments
                    weight[some] = np.add.reduceat(gain[s], at[some]) // n[some]
                known = ids.as_py()
                score = weight + np.array([noise(d, seed) for d in known], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(n, pa.int64()), pa.array(weight), pa.array(score)], names=["doc_id", "n_features", "weight", "score"])
        trim()

    return packed.mapInArrow(run, "doc_id long, n_features long, weight long, score long")


def _ranked(scored: DataFrame, tables: Scratch, min_words: int, percent: int) -> DataFrame:
    """``rank`` from 1 for the drawn rows, null for the others."""
    drawable = F.col("n_features") >= 2 * min_words - 1  # n words have n + (n - 1) features
    order = [(~drawable).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = tables.table(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("place", 33)
    sizes = sorted(map(tuple, placed.groupBy(part.alias("part")).agg(F.count("*"), F.sum(drawable.cast("long"))).collect()))  # a row per partition
    bases, base = [], 0
    for k, n, _ in sizes:
        bases.append((k, base))
        base += n
    drawn = sum(d for _, _, d in sizes) * percent // 100
    before = F.broadcast(scored.sparkSession.createDataFrame(bases, "part int, base long"))  # a row per partition
    rank = F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    joined = placed.withColumn("part", part.cast("int")).join(before, "part")
    return joined.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; ``target`` is any table with a text.

    Of the rows with at least ``min_words`` words the ``percent`` of highest score (rounded down) are drawn and
    ranked from 1; equal scores go by doc_id (null last), then by features and weight.  Null and empty texts
    have no features and weight 0.  Repeated rows are scored alike and ranked once each.  Without a target
    all shares are smoothed alone; an empty ``docs`` gives no rows; other columns are left out.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are packed into 16 bits")
    tables = Scratch(docs.sparkSession)
    packed = tables.table(bucket_streams(docs, buckets), "streams", False)
    wanted = bucket_streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets)
    own, aim = ({r["bucket"]: r["n"] for r in bucket_counts(p, buckets).collect()} for p in (packed, wanted))  # at most ``buckets`` rows each
    scored = tables.table(weigh(packed, gains(own, aim, buckets), seed), "scored", False)
    tables.drop(packed)
    out = _ranked(scored, tables, min_words, percent)
    tables.drop(scored)
    return out
