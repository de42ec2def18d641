"""Bradley-Terry quality scores learned from preference pairs.

A document of quality 1 is preferred to one of quality 0 (of any language or source).  The score is
linear in text features; its weights maximise the likelihood of the pairs, a logistic loss on the
feature difference of each pair.  The threshold is the quantile of the training scores at the share
of rejected training rows, and scores are mapped to (0, 1) so that this quantile lands on ``cut``.

Features come from bytes and word hashes of the whole text; labels, language, source and identifiers
are never read.  The fit uses at most ``max_train`` labelled rows (those with the least hash of their
identifier) and ``max_pairs`` pairs: both bounds are parameters and do not depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, ship_package
from .textscan import BLANK, word_hashes

#: Names of the features, in the order of the vectors.
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "stop_marks", "bang", "pipe", "symbols", "quotes", "other_marks", "line_feeds",
    "wide_bytes", "repeat_next", "repeat_two", "distinct_words", "top_word", "odd_controls", "root_upper", "root_symbols", "root_bang",
    "root_pipe", "root_repeat_next", "any_repeat_run",
)


def _class_table() -> np.ndarray:
    t = np.full(256, 9, dtype=np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"|", b"#$%&*@^~=+<>", b"\"'()[]{}", b"-_/\\`")):
        t[list(chars)] = k
    t[BLANK] = 10
    t[128:] = 11
    t[10] = 12
    t[[i for i in range(32) if i not in (9, 10, 11, 12, 13)] + [127]] = 13
    return t


_CLASS = _class_table()


def features(data: bytes) -> np.ndarray:
    """The feature vector of one text (UTF-8).  An empty text has the zero vector."""
    n = len(data)
    if not n:
        return np.zeros(len(FEATURES))
    c = np.zeros(14)
    for at in range(0, n, 1 << 20):
        c += np.bincount(_CLASS[np.frombuffer(data[at : at + (1 << 20)], dtype=np.uint8)], minlength=14)
    w = word_hashes(data)
    m = max(len(w), 1)
    ink = max(n - c[10] - c[12], 1)
    _, per_word = np.unique(w, return_counts=True)
    same = w[1:] == w[:-1]
    runs = same[1:] & same[:-1]
    r_next, r_two = same.sum() / m, (w[2:] == w[:-2]).sum() / m
    up, bang, pipe, sym = c[1] / ink, c[4] / ink, c[5] / ink, c[6] / ink
    return np.array([
        np.log1p(n), np.log1p(len(w)), np.log1p(ink / m), up, c[2] / ink, c[3] / ink, bang, pipe, sym, c[7] / ink, (c[8] + c[9]) / ink, c[12] / n,
        c[11] / ink, r_next, r_two, len(per_word) / m, (per_word.max() if len(per_word) else 0) / m, c[13] / n, up**0.5, sym**0.5, bang**0.5,
        pipe**0.5, r_next**0.5, runs.sum() / m,
    ])


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the feature vector of each whole text; null text counts as empty."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tolist() for v in x], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class RankModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, cut: float = 0.3, max_pairs: int = 60_000, l2: float = 1e-3, rounds: int = 25) -> RankModel:
    """Fit on rows ``x`` with labels ``y``.  Without both labels every score is 0.5."""
    d = len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return RankModel(np.zeros(d), np.ones(d), np.zeros(d), float(np.log(cut / (1 - cut))), cut, 1.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    # Every document meets opponents at fixed strides, so each appears about equally often.
    n = min(max_pairs, len(good) * len(bad))
    i = np.arange(n)
    stride = max(1, int(len(bad) * 0.618))
    diff = z[good[i % len(good)]] - z[bad[(i + (i // len(good)) * stride) % len(bad)]]
    w = np.zeros(d)
    for _ in range(rounds):  # Newton steps on the mean logistic loss with a ridge
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = -(diff * (1 - p)[:, None]).mean(axis=0) + l2 * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / n + (l2 + 1e-9) * np.eye(d)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    # Halfway between the neighbours of the quantile, so that a clear gap is cut in its middle.
    order, k = np.sort(raw), len(bad)
    threshold = float((order[k - 1] + order[min(k, len(order) - 1)]) / 2)
    return RankModel(mean, scale, w, threshold, cut, 1.0)


def labelled_features(feats: DataFrame, labels: DataFrame, max_train: int, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """The training rows: crc32 of the identifier's text not divisible by 5, at most ``max_train``, least hash first.

    Rows without a label or identifier are left out; of several labels of a document the mean decides, and
    of several rows of an identifier one (of least features) is read, so at most ``max_train`` rows are collected.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold != 0)).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    few = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(max_train)
    rows = feats.join(few, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toPandas()
    if not len(rows):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.array(rows["x"].tolist()), rows["y"].to_numpy()


def score_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_train: int = 20_000) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= ``cut``) of every document.

    Null and empty texts get the score of the zero vector.  Repeated rows are scored alike, once each.
    """
    feats = materialise(document_features(docs), "features")
    x, y = labelled_features(feats, labels, max_train)
    model = fit_pairs(x, y, cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            s = model.score(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return feats.mapInArrow(run, "doc_id long, score double, predicted int")
