"""Vectorised hashing of words, shingles and byte windows with numpy.

A prefix sum of ``(byte + 1) * P**i`` modulo 2**64 gives the hash of any substring with one
subtraction and one multiplication by the inverse power, so the cost is a few array passes over the
bytes and nothing runs once per word in the interpreter.
"""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial, its inverse modulo 2**64, and the two multipliers of the finaliser.
_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20

_tables: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``P**i`` and ``P**-i`` for i < n at least; kept and grown by doubling."""
    have = _tables.get("p")
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for key, base in (("p", _P), ("q", _P_INV)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _tables[key] = np.cumprod(t, dtype=np.uint64)
    return _tables["p"], _tables["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; ``x`` is a fresh uint64 array and is overwritten."""
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(a: np.ndarray) -> np.ndarray:
    p, _ = powers(len(a) + 1)
    c = np.zeros(len(a) + 1, dtype=np.uint64)
    t = a.astype(np.uint64)
    t += np.uint64(1)
    t *= p[: len(a)]
    np.cumsum(t, out=c[1:])
    return c


def _spans(a: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = ~blank[a]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: bytes, lower: bool = True, blank: np.ndarray = BLANK) -> np.ndarray:
    """One 64-bit hash per blank-separated word, in order.

    Long inputs are read in pieces cut at blanks; a word longer than a piece stays whole.
    """
    out, n, at = [], len(data), 0
    whole = np.frombuffer(data, dtype=np.uint8)
    while at < n:
        end = min(n, at + _CHUNK)
        while end < n and not blank[whole[end]]:
            end += 1
        a = whole[at:end]
        at = end
        if lower:
            a = LOWER[a]
        start, stop = _spans(a, blank)
        if not len(start):
            continue
        c = prefix_sums(a)
        h = c[stop] - c[start]
        h *= powers(len(a))[1][start]
        h += (stop - start).astype(np.uint64) * _STEP
        out.append(mix(h))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of ``k`` words (the whole sequence if shorter; none of no words), repeats kept."""
    n = len(words)
    if n == 0:
        return words
    k_eff = min(k, n)
    h = np.full(n - k_eff + 1, k_eff, dtype=np.uint64)
    for j in range(k_eff):
        h *= np.uint64(_P)
        h += words[j : n - k_eff + 1 + j]
    return mix(h)


def window_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k``-byte window of a byte array, by start."""
    n = len(a) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    c = prefix_sums(a)
    h = c[k:] - c[:n]
    h *= powers(len(a))[1][:n]
    return mix(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, in log2(w) passes."""
    if len(x) < w:
        return x[:0]
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    n = len(x) - w + 1
    return m[:n] if have == w else np.minimum(m[:n], m[w - have : w - have + n])
