"""Bottom-k sketches of shingle hashes.

A sketch is the ascending array of the ``k`` least distinct hashes (40 bits each) of a document's
five-word shingles; with fewer than k it is the whole set.  The least k of the union of two sketches is the sketch of the union, so sketches of parts merge exactly; resemblance, containment
and the distinct count follow from the merged one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship_package
from .textscan import shingle_hashes, word_hashes

_BITS = 40
_SPACE = float(1 << _BITS)


def sketch(data: bytes, k: int = 256, words: int = 5) -> np.ndarray:
    """The sketch of a text (UTF-8, A-Z lower-cased, words cut at ASCII blanks).  No words: empty."""
    h = np.unique(shingle_hashes(word_hashes(data), words) >> np.uint64(64 - _BITS))
    return h[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = 256) -> np.ndarray:
    """The sketch of the union of what ``a`` and ``b`` stand for."""
    return np.union1d(a, b)[:k]


def distinct(s: np.ndarray, k: int = 256) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[-1]) + 1) / _SPACE)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = 256) -> float:
    """Estimated Jaccard similarity; 1.0 for two empty sets, 0.0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    u = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, u[-1], side="right")) / len(u)


def containment(a: np.ndarray, b: np.ndarray, k: int = 256) -> float:
    """Estimated share of ``a`` that lies in ``b``; 1.0 if ``a`` is empty."""
    if not len(a):
        return 1.0
    size_a, union = distinct(a, k), distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / max(size_a, 1.0))


def to_text(s: np.ndarray) -> str:
    """Base64 of the big-endian 40-bit hashes."""
    raw = s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return base64.b64encode(raw.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 3:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def edit(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first as many code points of ``following``."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


_FIELDS = (
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles_est", pa.float64()),
)
_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles_est double"


def _row(doc: int | None, text: str, s: np.ndarray, following: str, s_next: np.ndarray, k: int) -> tuple:
    new = edit(text, following).encode()
    e = sketch(new, k)
    return (doc, len(text), hashlib.sha256(new).hexdigest(), to_text(s), to_text(e), resemblance(s, e, k), resemblance(s, s_next, k), distinct(s, k))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


#: Ranges of ids for each shuffle partition; they are dealt out by their bytes.
_RANGES_EACH = 8


def _ranges(docs: DataFrame) -> np.ndarray:
    """Borders that cut the ids into even ranges, some for each shuffle partition."""
    n = _RANGES_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], F.lit(10 * n)).alias("q")).first()["q"]
    return np.unique(np.array(found or [], dtype=np.int64))


def _deal(sizes: dict[int, int], n: int) -> dict[int, int]:
    """A task for each range, largest range first to the task with the least bytes so far."""
    tasks = [(0, t) for t in range(n)]
    out = {}
    for part in sorted(sizes, key=lambda p: (-sizes[p], p)):
        load, t = heapq.heappop(tasks)
        out[part] = t
        heapq.heappush(tasks, (load + sizes[part], t))
    return out


def _range_numbers(ids: pa.Array, borders: np.ndarray) -> np.ndarray:
    """The range of each id; nulls are in the first one."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    part = np.zeros(len(ids), dtype=np.int64)
    part[known] = np.searchsorted(borders, ids.drop_null().to_numpy(), side="right")
    return part


def with_followers(docs: DataFrame) -> DataFrame:
    """doc_id, text, part, tail: rows in order of (doc_id, text) within ranges of ids, each range in one partition.

    Behind the rows of each range (tail 0) stands its follower (tail 1), the first row of the next range
    that has rows; the last range is followed by the first one.  Per range, one number reaches the driver.
    """
    borders = _ranges(docs)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_range_numbers(b.column(0), borders))], names=["doc_id", "bytes", "part"])

    numbered = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")).mapInArrow(number, "doc_id long, bytes long, part long")
    found = numbered.groupBy("part").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
    firsts = sorted((r["part"], None if r["nulls"] else r["least"]) for r in found)
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    n_tasks = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(found)))
    task_of = _deal({r["part"]: r["bytes"] + 100 * r["n"] for r in found}, n_tasks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "part", "tail", "task"]

        def dealt(few: pa.RecordBatch, part: list[int], tail: int) -> pa.RecordBatch:
            task = pa.array([task_of[p] for p in part], pa.int32())
            return pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(part, pa.int64()), pa.array([tail] * len(part), pa.int32()), task], names=names)

        for b in batches:
            yield dealt(b, _range_numbers(b.column(0), borders).tolist(), 0)
            ids = b.column(0).to_pylist()
            heads: dict[int | None, int] = {}  # the least text of each follower's id in this batch
            for i, d in enumerate(ids):
                if d in before and (d not in heads or (b.column(1)[i].as_py() or "") < (b.column(1)[heads[d]].as_py() or "")):
                    heads[d] = i
            if heads:
                yield dealt(b.take(pa.array(list(heads.values()))), [before[d] for d in heads], 1)

    out = docs.select("doc_id", "text").mapInArrow(deal, "doc_id long, text string, part long, tail int, task int")
    return out.repartitionById(n_tasks, F.col("task")).sortWithinPartitions("part", "tail", "doc_id", "text").drop("task")


def fingerprint_documents(docs: DataFrame, k: int = 256) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, which ends in the start of the next document.

    The next document is the next row by ascending (doc_id, text), nulls first; the last row is followed
    by the first.  Null text counts as empty: its sketch is empty, and two empty sketches have likeness
    1.  Rows map one to one, repeated ones too; no rows give no rows.  Texts are shuffled once, by ranges
    of ids, and a task holds two of them at a time.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = []
            for doc, text, tail in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "tail")), strict=True):
                if tail and held is None:  # another row with the follower's id
                    continue
                text = text or ""
                s = sketch(text.encode(), k)
                if held is not None:
                    rows.append(_row(*held, text, s, k))
                held = None if tail else (doc, text, s)
            yield _batch(rows)

    return with_followers(docs).mapInArrow(run, _SQL)
