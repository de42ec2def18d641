"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``SPAN`` bytes that covers it also starts earlier in the corpus.

1. *Anchors.*  Winnowing marks, in every window of ``SPAN`` bytes, a ``GRAM``-byte gram of least hash, so
   equal windows have an equal gram at the same place in them.  A gram with its context (all windows that
   hold it) is one row; rows of equal gram and context repeat each other whole, and each task settles its
   own before anything is shuffled.  Contexts count as equal if two hashes of them are, of 64 and 32 bits;
   both are polynomial and share a multiplier, so they are not independent, and the bytes are not compared.
2. *Meeting.*  Rows meet by gram.  Equal contexts are settled; grams with several contexts ask for their
   bytes, which are few: they stand where copies begin, end or differ.
3. *Suffix arrays.*  The contexts of a gram come to one shard.  A shard is sorted by Larsson-Sadakane
   refinement (ranks of 7 symbols, doubled, only unsettled groups sorted again), common prefixes come from
   Kasai's algorithm in lanes, and runs with a common prefix of ``SPAN`` or more are equal windows.  A gram
   with more than ``HOT`` contexts is not left to one task: its windows are cut into classes by where the
   gram stands in them, ``STEP`` places to a class, and the contexts of a class go to shards by the bytes
   that all windows of the class share.  A key that still exceeds a shard is cut into shards in corpus
   order, and the windows of a later one are looked up in the earlier ones by binary search.
4. *Cutting.*  The ranges of repeated windows of a document are united and cut from its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, materialise, ship_package, trim
from .textscan import mix, powers, prefix_sums, sliding_min

SPAN, GRAM = 100, 32
_REACH = SPAN - GRAM
_PIECE = 1 << 20
_NULL_ID = -(1 << 63)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Contexts of a gram from which they are dealt out by more of their bytes, and how many windows then stay together.
HOT, STEP = 2048, 4
#: A random value for each byte, the second hash of contexts.
_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)


def _anchors_in(a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Positions, gram hashes and the two context hashes of the anchors of one byte array."""
    n = len(a)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    c, (p, q) = prefix_sums(a), powers(n + 1)
    g = c[GRAM:] - c[: n - GRAM + 1]
    g *= q[: n - GRAM + 1]
    g = mix(g)
    width = _REACH + 1
    least = sliding_min(g, width)
    pad = np.zeros(width - 1, dtype=np.uint64)
    most = ~sliding_min(~np.concatenate([pad, least, pad]), width)
    at = np.flatnonzero(most == g)
    lo, hi = np.maximum(at - _REACH, 0), np.minimum(at + SPAN, n)
    context = c[hi] - c[lo]
    context *= q[lo]
    context += (hi - at).astype(np.uint64) * _STEP + (at - lo).astype(np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[a] * p[:n], out=sums[1:])
    second = sums[hi] - sums[lo]
    second *= q[lo]
    return at, g[at], mix(context), (mix(second) >> np.uint64(32)).astype(np.uint32)


def anchors(data: bytes) -> tuple[np.ndarray, ...]:
    """The same for any length: long texts are read in overlapping pieces."""
    a = np.frombuffer(data, dtype=np.uint8)
    if len(a) <= _PIECE:
        return _anchors_in(a)
    parts, lap = [], 2 * SPAN
    for start in range(0, len(a), _PIECE):
        lo, hi = max(0, start - lap), min(len(a), start + _PIECE + lap)
        at, *hashes = _anchors_in(a[lo:hi])
        at = at + lo
        own = (at >= start) & (at < start + _PIECE)
        parts.append((at[own], *(h[own] for h in hashes)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# A place in the corpus is (did, tie, place): did is doc_id, or the least long for null; tie orders rows that
# share an id; place packs the position and how many bytes of context stand before and behind it.


def _pack(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (at << 15) | (left << 7) | right


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, first byte and end of the context."""
    at = place >> 15
    return at, at - ((place >> 7) & 0xFF), at + (place & 0x7F)


#: p is the gram for kinds 0 and 2; rows of kind 1 only pass through.
_ROW = "p long, kind int, context long, second int, did long, tie long, place long"
_NAMES = ["p", "kind", "context", "second", "did", "tie", "place"]


def _rows(kind: int, p: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    context, second, *rest = columns
    cols = [pa.array(p.view(np.int64)), pa.array(np.full(len(p), kind, dtype=np.int32)), pa.array(context.view(np.int64)), pa.array(second.view(np.int32)), *(pa.array(x.view(np.int64)) for x in rest)]
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def _publish(batches: Iterator[pa.RecordBatch], hold: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: the first row of each (gram, context) here; kind 1: a place whose windows all repeat."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal parts, held
        g, c, s, d, t, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts, held = [], 0
        order = np.lexsort((at, t, d, s, c, g) if t.any() else (at, d, s, c, g))
        g, c, s, d, t, at = (x[order] for x in (g, c, s, d, t, at))
        first = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
        for mask, kind in ((first, 0), (~first, 1)):
            places = np.flatnonzero(mask)
            for k in range(0, len(places), 250_000):
                i = places[k : k + 250_000]
                about = (g[i], c[i], s[i]) if kind == 0 else (d[i], np.zeros(len(i), np.int64), np.zeros(len(i), np.int32))
                yield _rows(kind, *about, d[i], t[i], at[i])

    for b in batches:
        for doc, text, tie in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            if not text or len(text) < SPAN:
                continue
            at, g, c, second = anchors(text)
            place = _pack(at, np.minimum(at, _REACH), np.minimum(SPAN, len(text) - at))
            parts.append((g, c, second, np.full(len(at), doc, dtype=np.int64), np.full(len(at), tie, dtype=np.int64), place))
            held += len(at)
            if held >= hold:
                yield from flush()
    if held:
        yield from flush()
    trim()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by kind, then gram, context and place.  Kind 1: repeats whole; kind 2: its bytes are asked for."""
    last: tuple[int, int, int] | None = None  # gram and context of the row before
    pending: tuple | None = None  # first row of a gram with one context so far
    for b in batches:
        g, kind, *rest = (b.column(n).to_numpy() for n in _NAMES)
        if (kind == 1).any():
            yield b.filter(pa.array(kind == 1))
        x = kind == 0
        if not x.any():
            continue
        g, *rest = (v[x] for v in (g, *rest))
        c, s = rest[:2]
        same_g = np.concatenate([[last is not None and last[0] == g[0]], g[1:] == g[:-1]])
        same = same_g & np.concatenate([[last is not None and last[1:] == (c[0], s[0])], (c[1:] == c[:-1]) & (s[1:] == s[:-1])])
        if same.any():
            yield _rows(1, g[same], *(v[same] for v in rest))
        new = np.flatnonzero(~same)
        if len(new):
            cont = same_g[new]
            begins = np.flatnonzero(~cont)
            # Contexts that follow another one of their gram, and the first of each such gram.
            ask = cont.copy()
            firsts = begins[np.append(begins[1:], len(new)) - begins > 1]
            ask[firsts] = True
            if cont[0] and pending is not None:
                yield _rows(2, *(np.array([v], dtype=np.int32 if k == 2 else np.int64) for k, v in enumerate(pending)))
            if cont[0] or len(begins):
                pending = None
            i = new[ask]
            if len(i):
                yield _rows(2, g[i], *(v[i] for v in rest))
            if len(begins) and not ask[begins[-1]] and begins[-1] == len(new) - 1:
                k = new[-1]
                pending = tuple(int(v[k]) for v in (g, *rest))
        last = (int(g[-1]), int(c[-1]), int(s[-1]))


# ---- suffix arrays of one shard


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` symbols at least, and the rank of each.

    ``text`` holds symbols below 511.  Groups of equal prefixes are numbered by their last index, as
    Larsson and Sadakane do; each doubling sorts only groups of two or more.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    have = 7
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(have, np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for j in range(have):
        key = (key << 9) | padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)

    def number(lo_keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Group numbers for ``slots`` (ascending places in sa) with sorted keys."""
        ends = np.append(lo_keys[1:] != lo_keys[:-1], True)
        last = np.flatnonzero(ends)
        return slots[last[np.searchsorted(last, np.arange(len(slots)))]]

    rank[sa] = number(key[sa], np.arange(n))
    while have < depth:
        r = rank[sa]
        alone = np.append(r[1:] != r[:-1], True) & np.concatenate([[True], r[1:] != r[:-1]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        who = sa[slots]
        behind = who + have
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        key = rank[who] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sa[slots] = who[order]
        rank[who[order]] = number(key[order], slots)
        have *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 2048) -> np.ndarray:
    """Kasai's algorithm: entry i is the common prefix, up to ``cap``, of suffixes sa[i - 1] and sa[i].

    Positions are walked in text order in ``lanes`` equal stretches side by side; the length found at a
    position less one is known at the next, so each lane extends about once per symbol.
    """
    n = len(sa)
    lcp = np.zeros(n, dtype=np.int64)
    if n < 2:
        return lcp
    where = np.empty(n, dtype=np.int64)
    where[sa] = np.arange(n)
    prev = np.full(n, -1, dtype=np.int64)
    prev[sa[1:]] = sa[:-1]
    ends = np.concatenate([text.astype(np.int64), np.full(cap + 1, -1, np.int64)])
    lanes = max(1, min(lanes, n // 64))
    step = -(-n // lanes)
    start = np.arange(0, n, step)
    h = np.zeros(len(start), dtype=np.int64)
    found = np.zeros(n, dtype=np.int64)
    for t in range(step):
        i = start + t
        live = np.flatnonzero(i < n)
        i = i[live]
        j = prev[i]
        k = np.maximum(h[live] - 1, 0)
        k[j < 0] = 0
        go = np.flatnonzero(j >= 0)
        while len(go):
            x, y = i[go] + k[go], j[go] + k[go]
            ok = (k[go] < cap) & (x < n) & (y < n)
            ok &= ends[np.minimum(x, n + cap)] == ends[np.minimum(y, n + cap)]
            go = go[ok]
            k[go] += 1
        h[live] = k
        found[i] = k
    lcp[where] = found
    lcp[0] = 0
    return lcp


class Shard:
    """Contexts of some grams with their equal windows, and the sorted distinct windows for look-ups."""

    def __init__(self, slices: list[bytes], did: np.ndarray, start: np.ndarray, rows: np.ndarray) -> None:
        """Slice k is bytes ``start[k]`` on of document ``did[k]`` (any numbers in corpus order), row ``rows[k]`` of the caller."""
        lens = np.array([len(s) for s in slices], dtype=np.int64)
        base = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        text = np.full(int((lens + 1).sum()), 256, dtype=np.int16)
        self.raw = np.zeros(len(text) + SPAN, dtype=np.uint8)
        for s, at in zip(slices, base.tolist(), strict=True):
            a = np.frombuffer(s, dtype=np.uint8)
            text[at : at + len(a)] = a
            self.raw[at : at + len(a)] = a
        owner = np.repeat(np.arange(len(slices)), lens + 1)
        inside = np.arange(len(text)) - base[owner]
        valid = inside + SPAN <= lens[owner]
        sa, _ = suffix_array(text, len(text))  # Kasai needs the full order
        lcp = common_prefixes(text, sa, SPAN)
        group = np.cumsum(lcp < SPAN)
        keep = valid[sa]
        self.at, self.group = sa[keep], group[keep]
        self.owner, self.row = owner[self.at], rows[owner[self.at]]
        self.did, self.start = did[self.owner], start[self.owner] + inside[self.at]

    def repeats(self) -> np.ndarray:
        """Which windows (in suffix order) equal one that starts earlier."""
        order = np.lexsort((self.start, self.did, self.group))
        g, d, s = self.group[order], self.did[order], self.start[order]
        new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(g) else np.zeros(0, np.int64)
        out = np.zeros(len(g), dtype=bool)
        out[order] = (d != d[lead]) | (s != s[lead])
        return out

    def windows(self) -> np.ndarray:
        """The windows in suffix order as fixed-width byte strings, which sort alike."""
        view = np.lib.stride_tricks.sliding_window_view(self.raw, SPAN)[self.at]
        return np.ascontiguousarray(view).view(f"S{SPAN}").ravel()


def _found_in(known: tuple[np.ndarray, ...], windows: np.ndarray, did: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows equal one of the sorted ``known`` (windows, did, tie, start) that starts earlier; binary search."""
    if not len(known[0]) or not len(windows):
        return np.zeros(len(windows), dtype=bool)
    at = np.minimum(np.searchsorted(known[0], windows), len(known[0]) - 1)
    found, d, t, s = (v[at] for v in known)
    earlier = (d < did) | ((d == did) & ((t < tie) | ((t == tie) & (s < start))))
    return (found == windows) & earlier


_RANGES = "did long, tie long, lo long, hi long"


def _ranges(did: np.ndarray, tie: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of adjacent window starts, as (first, last)."""
    order = np.lexsort((start, tie, did))
    d, t, s = did[order], tie[order], start[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + 1)]) if len(d) else np.zeros(0, bool)
    i = np.flatnonzero(new)
    last = np.append(i[1:], len(d)) - 1 if len(i) else i
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[i], t[i], s[i], s[last])], names=["did", "tie", "lo", "hi"])


def _reach(sides: np.ndarray, lens: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row the longest prefix that it shares with another row of its group, or more.

    Rows are sorted, so the best partner is a neighbour.  Padding counts as shared, which can only
    make the answer longer.
    """
    n, width = sides.shape
    key = np.zeros((n, 4 + width), dtype=np.uint8)
    key[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    key[:, 4:] = sides
    order = np.argsort(key.view(f"S{4 + width}").ravel(), kind="stable")
    s, g = sides[order], group[order]
    differs = np.concatenate([s[1:] != s[:-1], np.ones((max(n - 1, 0), 1), dtype=bool)], axis=1)
    shared = np.where(g[1:] == g[:-1], differs.argmax(axis=1), 0) if n > 1 else np.zeros(0, np.int64)
    best = np.zeros(n, dtype=np.int64)
    best[order] = np.maximum(np.append(shared, 0), np.concatenate([[0], shared]) if n else shared)
    return np.minimum(best, lens)


def _trimmed(slices: list[bytes], gram: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before and behind its gram each context can share with another one of the gram."""
    n, lens = len(slices), np.array([len(x) for x in slices], dtype=np.int64)
    flat = np.frombuffer(b"".join(slices) + bytes(SPAN), dtype=np.uint8)
    base = np.concatenate([[0], np.cumsum(lens)[:-1]]) + before
    steps = np.arange(_REACH)
    left = flat[np.maximum(base[:, None] - 1 - steps, 0)]
    left[steps[None] >= before[:, None]] = 0
    behind = lens - before - GRAM
    right = flat[np.minimum(base[:, None] + GRAM + steps, len(flat) - 1)]
    right[steps[None] >= behind[:, None]] = 0
    group = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]])) if n else np.zeros(0, np.int64)
    return _reach(left, before, group), _reach(right, behind, group)


def _sort_shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, did, tie, place); a key is a gram, or a part of one.

    A shard of whole keys first cuts each context to what another context of its key can share: most
    are too short then, and equal rests repeat the first of them.  What is left is sorted.  A key that
    exceeds a shard is sorted as it is, in shards in corpus order, later ones looked up in earlier ones.
    """
    rows: list[tuple[int, int, int, int, bytes]] = []  # key, did, tie, place, bytes
    size = begins = 0  # bytes held; where the current key begins
    current = None
    known: list[tuple[np.ndarray, ...]] = []  # sorted new windows of the current key's earlier shards

    def column(part: list[tuple], k: int) -> np.ndarray:
        return np.array([r[k] for r in part], dtype=np.int64)

    def sort(part: list[tuple], lo: np.ndarray, cut: bool) -> pa.RecordBatch:
        did, tie = column(part, 1), column(part, 2)
        order = np.lexsort((tie, did))
        new = np.concatenate([[False], (did[order][1:] != did[order][:-1]) | (tie[order][1:] != tie[order][:-1])])
        rank = np.empty(len(part), dtype=np.int64)
        rank[order] = np.cumsum(new)
        s = Shard([r[4] for r in part], rank, lo, np.arange(len(part)))
        bad, d, t = s.repeats(), did[s.row], tie[s.row]
        if known or cut:
            w = s.windows()
            for k in known:
                bad |= _found_in(k, w, d, t, s.start)
            if cut:
                known.append((w[~bad], d[~bad], t[~bad], s.start[~bad]))  # suffix order is byte order
        return _ranges(d[bad], t[bad], s.start[bad])

    def whole(part: list[tuple]) -> Iterator[pa.RecordBatch]:
        at, lo, _ = _unpack(column(part, 3))
        left, right = _trimmed([r[4] for r in part], column(part, 0), at - lo)
        first: dict[tuple, int] = {}
        repeat, count = [], {}
        for i in np.flatnonzero(left + right >= _REACH).tolist():
            g, data = part[i][0], part[i][4]
            k = int(at[i] - lo[i] - left[i])
            key = (g, int(left[i]), data[k : k + int(left[i] + right[i]) + GRAM])
            j = first.setdefault(key, i)
            if j != i:
                repeat.append(i)
            else:
                count[g] = count.get(g, 0) + 1
        if repeat:
            r = np.array(repeat)
            bad = [part[i] for i in repeat]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (column(bad, 1), column(bad, 2), at[r] - left[r], at[r] + right[r] - _REACH)], names=["did", "tie", "lo", "hi"])
        # A single rest of a key has no partner here, but its windows may meet those of other rests.
        left_over = [(k, i) for k, i in first.items() if count[k[0]] > 1]
        n = 0
        while n < len(left_over):
            end = min(n + 10_000, len(left_over))
            while end < len(left_over) and left_over[end][0][0] == left_over[end - 1][0][0]:
                end += 1
            block = left_over[n:end]
            n = end
            yield sort([(k[0], *part[i][1:4], k[2]) for k, i in block], np.array([int(at[i]) - k[1] for k, i in block]), False)

    def full() -> np.ndarray:
        return _unpack(column(rows, 3))[1]

    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in ("gram", "did", "tie", "place", "data")), strict=True):
            if row[0] != current:
                if known:
                    yield sort(rows, full(), False)
                    rows, size, known = [], 0, []
                elif size >= shard_bytes // 2:
                    yield from whole(rows)
                    rows, size = [], 0
                current, begins = row[0], len(rows)
            elif size >= shard_bytes:
                if begins:
                    yield from whole(rows[:begins])
                    rows = rows[begins:]
                    size, begins = sum(len(r[4]) for r in rows), 0
                if size >= shard_bytes:
                    yield sort(rows, full(), True)
                    rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        if known:
            yield sort(rows, full(), False)
        else:
            yield from whole(rows)


def _contexts(data: bytes, wants: list[dict]) -> Iterator[tuple[int, int, bytes]]:
    """Key, place and bytes of the contexts that are asked for, those of hot grams by class of windows."""
    at, lo, hi = _unpack(np.array([w["place"] for w in wants], dtype=np.int64))
    for w, i, a, b in zip(wants, at.tolist(), lo.tolist(), hi.tolist(), strict=True):
        if not w["hot"]:
            yield w["gram"], w["place"], data[a:b]
            continue
        for k in range(0, _REACH + 1, STEP):  # windows that start k to k + STEP - 1 bytes before the gram
            core = i - k
            begin, end = max(a, core - min(STEP - 1, _REACH - k)), min(b, core + SPAN)
            if core >= a and end - begin >= SPAN:
                shared = data[core : core + SPAN - min(STEP - 1, _REACH - k)]
                name = hashlib.blake2b(shared, digest_size=8, salt=k.to_bytes(2, "big")).digest()
                yield int.from_bytes(name, "big", signed=True), (core << 15) | ((core - begin) << 7) | (end - core), data[begin:end]


def repeated_ranges(docs: DataFrame, hold: int = 1_500_000, shard_bytes: int = 8_000_000, hot: int = HOT) -> DataFrame:
    """A table (did, tie, lo, hi): windows that start at bytes lo to hi of a document also start earlier.  ``docs`` is of ``with_keys``."""

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _publish(batches, hold)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for b in batches:
            out: list[tuple] = []
            for d, t, data, wants in zip(b.column("did").to_pylist(), b.column("tie").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("wants").to_pylist(), strict=True):
                for key, place, part in _contexts(data, wants):
                    out.append((key, d, t, place, part))
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["gram", "did", "tie", "place", "data"])
                    out = []
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["gram", "did", "tie", "place", "data"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sort_shards(batches, shard_bytes)

    def meeting() -> DataFrame:
        found = docs.select("did", "text", "tie").mapInArrow(publish, _ROW).repartition("p").sortWithinPartitions("kind", "p", "context", "second", "did", "tie", "place").mapInArrow(_meet, _ROW)
        return found.select("kind", F.when(F.col("kind") == 2, F.col("p")).alias("gram"), "did", "tie", "place")

    tables = Scratch(docs.sparkSession)
    met = tables.table(meeting(), "met")  # no name holds its plan, so that its shuffle files can go
    asked = met.where("kind = 2")
    often = asked.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("gram", F.lit(True).alias("hot"))
    asked = asked.join(often, "gram", "left").select("did", "tie", F.struct("gram", "place", F.coalesce("hot", F.lit(False)).alias("hot")).alias("want"))
    wants = asked.groupBy("did", "tie").agg(F.collect_list("want").alias("wants"))
    bytes_of = docs.join(wants, ["did", "tie"]).select("did", "tie", "text", "wants").mapInArrow(fetch, "gram long, did long, tie long, place long, data binary")
    sorted_out = bytes_of.repartition("gram").sortWithinPartitions("gram", "did", "tie", "place").mapInArrow(shards, _RANGES)
    at = F.shiftright("place", 15)
    left, right = F.shiftright("place", 7).bitwiseAND(F.lit(0xFF)), F.col("place").bitwiseAND(F.lit(0x7F))
    whole = met.where("kind = 1").select("did", "tie", (at - left).alias("lo"), (at + right - SPAN).alias("hi"))
    out = materialise(whole.unionByName(sorted_out), "ranges")
    tables.drop(met)
    return out


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, did and tie.  Only where an id stands in several rows, tie is the hash of the text; otherwise it is 0."""
    repeated = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    tie = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("did"), tie.alias("tie"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document.

    Null text counts as empty.  Texts shorter than 100 bytes stay whole.  Rows are ordered by doc_id,
    nulls first; rows that share an id are ordered by a 64-bit hash of their text, and such rows with equal
    text are one document that is returned once each.
    """
    ship_package(docs.sparkSession)
    keyed = with_keys(docs)
    ranges = repeated_ranges(keyed).groupBy("did", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, data, cut in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("cut").to_pylist(), strict=True):
                data = data or b""
                spans = unite([(x["lo"], x["hi"] + SPAN) for x in cut or ()])
                kept, at = [], 0
                for i, j in spans:
                    kept.append(data[at:i])
                    at = j
                rest = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = keyed.join(ranges, ["did", "tie"], "left").select("doc_id", "text", "cut")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (start, end) spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], j))
        else:
            out.append((i, j))
    return out
