"""Exact n-gram Jaccard self-join with parity sketches.

The tokens of a document are the hashes of its distinct five-word shingles.  Two sketches are made of
them by XOR, and one token more or less changes one place of either, so the number of places in which two
sketches differ is a lower bound of the symmetric difference:

* the *bit sketch*: a token flips one of ``width`` parity bits (a power of two, twice the set's size or
  more); the Hamming distance of two bit sketches rejects pairs before any token set is fetched;
* the *block sketch*: a token is XOR-ed into one of ``m`` blocks of 2**64 parity bits, each kept as its
  linear 64-bit hash; blocks are what the pigeonhole join compares.

Jaccard similarity of 0.8 or more allows ``d = (a + b) * (1 - 0.8) / (1 + 0.8)`` differences for set sizes a
and b; one of any ``d + 1`` non-empty blocks of one document is then equal in the other (pigeonhole), and
the first such block stands among the first ``d + 1`` of both.  Documents publish these blocks, in every
size band in which they can have a partner, and meet in buckets of equal blocks.

Frequent tokens, those of many documents, would make large buckets, so they come last:

* level 0 sketches only the rest.  A document with more than ``d`` non-empty blocks is done: none of its
  partners can be missed;
* the others also publish those of their tokens that are not frequent one by one.  Two of them that meet
  nowhere so far share none of these tokens, so all ``t_x + t_y`` of them are differences, and only
  ``d - t_x - t_y`` are left for the frequent part.  A document with ``t > d`` is therefore done;
* level 1 sketches the frequent tokens of what is left, in blocks that are as large as this rest allows,
  per narrow size band and pair of bands of t.  In a family of near copies most pairs differ in more
  tokens of their own than that, and meet nowhere;
* level 2, for documents with too few non-empty blocks on level 1: every frequent token is a block.

The list of frequent tokens is an optimisation: any list, of any size, gives the same links.

Documents with equal sets are one class from the start.  In a bucket a star is verified first.  Members
that are still in different components are compared by bit sketch in the second round, inside the tasks
and in tiles of bounded size; a task passes on pairs that would connect its components (a forest), and only
what a failed pair leaves open is passed on whole.  So pairs grow with the members of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import Scratch, materialise, ship_package, trim
from .textscan import mix, shingle_hashes, word_hashes

_C1, _C2, _C3 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)


@dataclass(frozen=True)
class JoinSettings:
    #: Similarity threshold as a fraction ``num / den``.
    num: int = 4
    den: int = 5
    words: int = 5
    #: Tokens found in this many classes or more count as frequent; at most ``max_frequent`` are listed.
    frequent_from: int = 32
    max_frequent: int = 200_000
    #: Members of a bucket that one task compares with as many others; larger buckets are cut into tiles.
    tile: int = 4096
    #: Rounds in which forests are passed on, before all pairs that are left are.
    forest_rounds: int = 1

    def largest_partner(self, n: int) -> int:
        return n * self.den // self.num

    def differences(self, a: int, b: int) -> int:
        """Largest symmetric difference that sets of these sizes can have at the threshold."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def linked(self, a: int, b: int, both: int) -> bool:
        return self.den * both >= self.num * (a + b - both)


def tokens_of(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (UTF-8)."""
    return np.unique(shingle_hashes(word_hashes(text), words))


def class_id(tokens: np.ndarray) -> int:
    """A signed 64-bit name of the token set; 0 for the empty set."""
    if not len(tokens):
        return 0
    x = np.array([np.add.reduce(mix(tokens * _C1)), np.bitwise_xor.reduce(mix(tokens + _C2)), len(tokens)], dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = mix(x)
        return int(mix(h[:1] * _C1 + h[1:2] * _C2 + h[2:])[0].astype(np.int64)) or 1


def bit_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity bits as 64-bit words; at least twice as many bits as tokens."""
    width = max(512, 1 << (2 * len(tokens) - 1).bit_length())
    bit = (mix(tokens * _C3) & np.uint64(width - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=width) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same tokens with fewer bits."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def hamming(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets, from their bit sketches."""
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())


def _band(n: int) -> int:
    return n.bit_length() - 1


def _narrow_tops() -> list[int]:
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, tops[-1] * 5 // 4))
    return tops


#: Largest size of each narrow band; a document and its partners lie in two or three of them.
_TOPS = _narrow_tops()


def _blocks(tokens: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and contents of the non-empty ones of ``m`` blocks, in order."""
    block = mix(tokens * _C2 + np.uint64(seed)) % np.uint64(m)
    order = np.argsort(block, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, dtype=np.int64)
    return block[first], np.bitwise_xor.reduceat(tokens[order], first) if len(first) else tokens[:0]


def _names(number: np.ndarray, content: np.ndarray, index: int) -> np.ndarray:
    """64-bit names of blocks of one index."""
    return mix(mix(content * _C2 + number) + np.uint64(index * int(_C1) % 2**64))


def _own_bands(d: int) -> list[int]:
    """Least number of rare tokens of each band of t, for d differences at most."""
    return [0, -(-d // 4), -(-d // 2)]


def signatures(tokens: np.ndarray, frequent: np.ndarray, s: JoinSettings) -> np.ndarray:
    """What a set publishes: 64-bit names of blocks, each with its level and bands."""
    n = len(tokens)
    if not n:
        return tokens
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
        rare, common = tokens[~often], tokens[often]
    else:
        rare, common = tokens, tokens[:0]
    out, band, whole = [], _band(n), True
    while True:  # level 0, per octave of sizes
        d = s.differences(n, min(s.largest_partner(n), 2 ** (band + 1) - 1))
        number, content = _blocks(rare, (2**band * 13 + 19) // 20 + 3, band)
        out.append(_names(number[: d + 1], content[: d + 1], 4 * band))
        whole = whole and len(number) > d
        band += 1
        if s.largest_partner(n) < 2**band:
            break
    if whole:
        return np.concatenate(out)
    d = s.differences(n, s.largest_partner(n))
    out.append(_names(rare[: d + 1], rare[: d + 1], 1))  # tokens are sorted: the same order in all documents
    t = len(rare)
    if t > d:
        return np.concatenate(out)
    k = int(np.searchsorted(_TOPS, n))
    while True:  # levels 1 and 2, per narrow band of sizes and band of the partner's t
        top = _TOPS[k]
        d, limit = s.differences(n, min(s.largest_partner(n), top)), s.differences(top, top)
        bands = _own_bands(limit)
        own = max(i for i, least in enumerate(bands) if least <= t)
        for other, least in enumerate(bands):
            e = d - t - least
            if e < 0:
                break
            index = ((k * 4 + min(own, other)) * 4 + max(own, other)) * 4 + 2
            number, content = _blocks(common, max(limit - bands[own] - least, 0) * 5 // 4 + 4, index)
            out.append(_names(number[: e + 1], content[: e + 1], index))
            if len(number) <= e:
                out.append(_names(common[: e + 1], common[: e + 1], index + 1))
        k += 1
        if s.largest_partner(n) <= top:
            break
    return np.concatenate(out)


_SURVEY = "kind int, doc_id long, n_shingles long, cid long, sketch binary, token long, n long"


def survey(docs: DataFrame, hold: int = 3_000_000, s: JoinSettings = JoinSettings()) -> DataFrame:
    """Kind 0: doc_id, size, class and bit sketch of each document, null text counting as empty.
    Kind 1: tokens and in how many classes a task met them, for those met four times or more; these
    rows follow the number of tasks and not the number of tokens.
    """
    schema = pa.schema([("kind", pa.int32()), *((x, pa.int64()) for x in ("doc_id", "n_shingles", "cid")), ("sketch", pa.binary()), ("token", pa.int64()), ("n", pa.int64())])

    def batch(kind: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
        given = columns | {"kind": pa.array(np.full(rows, kind, dtype=np.int32))}
        return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, size
            t, n = np.unique(np.concatenate(parts), return_counts=True)
            parts, size = [], 0
            t, n = t[n >= 4], n[n >= 4]
            return batch(1, len(t), token=pa.array(t.view(np.int64)), n=pa.array(n))

        for b in batches:
            sizes, classes, sketches = [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                u = tokens_of(t or b"", s.words)
                c = class_id(u)
                sizes.append(len(u))
                classes.append(c)
                sketches.append(bit_sketch(u).tobytes() if len(u) and c not in seen else None)
                if c in seen or not len(u):
                    continue
                seen.add(c)
                parts.append(u)
                size += len(u)
                if size >= hold:
                    yield flush()
            yield batch(0, b.num_rows, doc_id=b.column(0), n_shingles=pa.array(sizes, pa.int64()), cid=pa.array(classes, pa.int64()), sketch=pa.array(sketches, pa.binary()))
        if parts:
            yield flush()
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SURVEY)


def frequent_tokens(surveyed: DataFrame, s: JoinSettings) -> np.ndarray:
    """Sorted tokens that occur in ``frequent_from`` classes or more, the most frequent ``max_frequent``."""
    counts = surveyed.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= s.frequent_from).orderBy(F.desc("n"), "token").limit(s.max_frequent)
    rows = top.select("token").toPandas()["token"].to_numpy()
    return np.sort(rows.astype(np.int64).view(np.uint64))


def candidates(docs: DataFrame, frequent: np.ndarray, s: JoinSettings, hold: int = 2_000_000) -> DataFrame:
    """Rows (kind 1: an edge (a, b) to verify; kind 2: ``a`` is a member of bucket ``b``), with sizes.

    Each task first meets its own classes: per bucket it sends one row on, so that a bucket that fills a
    third of the corpus reaches the next stage as one row per task.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(frequent)  # at most max_frequent numbers
    names = ["p", "kind", "a", "na", "b", "nb"]

    def batch(kind: int, p: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array(p.astype(np.int64)), pa.array(np.full(len(p), kind, dtype=np.int32)), *(pa.array(x.astype(np.int64)) for x in (a, na, b, nb))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def buckets(sig: np.ndarray, cid: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sorted by (bucket, class), repeats of a class in a bucket dropped; and where buckets begin."""
        order = np.lexsort((cid, sig))
        sig, cid, size = sig[order], cid[order], size[order]
        keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1])]) if len(sig) else np.zeros(0, bool)
        sig, cid, size = sig[keep], cid[keep], size[keep]
        first = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
        return sig, cid, size, first

    def near(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        return s.den * np.minimum(na, nb) >= s.num * np.maximum(na, nb)

    def unique_edges(a, na, b, nb):
        flip = a > b
        a, b, na, nb = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, nb, na), np.where(flip, na, nb)
        order = np.lexsort((b, a))
        a, b, na, nb = a[order], b[order], na[order], nb[order]
        keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        return a[keep], na[keep], b[keep], nb[keep]

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        cids: list[int] = []
        sizes: list[int] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sigs, cids, sizes, held
            lens = np.array([len(x) for x in sigs])
            sig, cid, size, first = buckets(np.concatenate(sigs).view(np.int64), np.repeat(np.array(cids, dtype=np.int64), lens), np.repeat(np.array(sizes, dtype=np.int64), lens))
            sigs, cids, sizes, held = [], [], [], 0
            at = np.flatnonzero(first)
            count = np.diff(np.append(at, len(sig)))
            # kind 0: the bucket's first class here, and how many classes it has here
            for k in range(0, len(at), 200_000):
                x = at[k : k + 200_000]
                yield batch(0, sig[x], cid[x], size[x], np.zeros(len(x)), count[k : k + 200_000])
            rest = np.flatnonzero(~first)
            if len(rest):
                lead = np.repeat(at, count)[rest]
                a, na, b, nb = unique_edges(cid[lead], size[lead], cid[rest], size[rest])
                ok = near(na, nb)
                yield batch(1, a[ok] ^ b[ok], a[ok], na[ok], b[ok], nb[ok])
                yield batch(2, cid[rest], cid[rest], size[rest], sig[rest], np.zeros(len(rest)))

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                u = tokens_of(t or b"", s.words)
                c = class_id(u)
                if c in seen or not len(u):
                    continue
                seen.add(c)
                x = signatures(u, often, s)
                sigs.append(x)
                cids.append(c)
                sizes.append(len(u))
                held += len(x)
                if held >= hold:
                    yield from flush()
        if held:
            yield from flush()
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partitions hold whole buckets, sorted by (kind, p, a).  A bucket that continues in the next batch is carried by its first row."""
        lead: tuple[int, int, int] | None = None  # bucket, class and size of its first row so far
        told = False  # the first row is on record as a member
        for b in batches:
            p, kind, a, na, bb, nb = (b.column(n).to_numpy() for n in names)
            for k in (1, 2):
                if (kind == k).any():
                    yield b.filter(pa.array(kind == k))
            x = kind == 0
            if not x.any():
                continue
            sig, cid, size, count = p[x], a[x], na[x], nb[x]
            if lead is not None:
                sig, cid, size, count = np.append(lead[0], sig), np.append(lead[1], cid), np.append(lead[2], size), np.append(0, count)
            first = np.concatenate([[True], sig[1:] != sig[:-1]])
            at = np.flatnonzero(first)
            n = np.diff(np.append(at, len(sig)))
            rest = np.flatnonzero(~first)
            wide = np.repeat(n, n) > 1
            member = wide | (count > 1)
            if lead is not None:
                member[0] = member[0] and not told
            if member.any():
                yield batch(2, cid[member], cid[member], size[member], sig[member], np.zeros(int(member.sum())))
            if len(rest):
                head = np.repeat(at, n)[rest]
                e = unique_edges(cid[head], size[head], cid[rest], size[rest])
                ok = near(e[1], e[3]) & (e[0] != e[2])
                yield batch(1, (e[0] ^ e[2])[ok], *(v[ok] for v in e))
            last = at[-1]
            was_told = told and last == 0 and lead is not None
            lead, told = (int(sig[last]), int(cid[last]), int(size[last])), bool(member[last]) or was_told

    schema = "p long, kind int, a long, na long, b long, nb long"
    return docs.select("text").mapInArrow(publish, schema).repartition("p").sortWithinPartitions("kind", "p", "a").mapInArrow(meet, schema).drop("p")


def verified(pairs: DataFrame, sets: DataFrame, s: JoinSettings) -> DataFrame:
    """The pairs (a, b) whose token sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                keep.append(s.linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    # Both joins read ``sets`` as it is, so that Spark shuffles it once and reuses the exchange.
    first = pairs.select("a", "b").join(sets, F.col("a") == F.col("cid")).select("a", "b", F.col("tokens").alias("ta"))
    both = first.join(sets, F.col("b") == F.col("cid")).select("a", "b", "ta", F.col("tokens").alias("tb"))
    return both.mapInArrow(run, "a long, b long")


def token_sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, tables: Scratch, s: JoinSettings) -> DataFrame:
    """A table of cid and the sorted token hashes of the wanted classes, read from their least document.

    A class that stands only in rows without a doc_id is read from those, by its own hash.
    """
    few = tables.table(classes.select("cid", "doc_id").join(wanted.select("cid").distinct(), "cid"), "wanted", False)  # read twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [tokens_of(t or b"", s.words) for t in b.column("text").cast(pa.binary()).to_pylist()]
            own = pa.array([class_id(u) == c for u, c in zip(sets, b.column("cid").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([u.tobytes() for u in sets], pa.binary())], names=["cid", "tokens"]).filter(own)

    def without_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [tokens_of(t or b"", s.words) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([class_id(u) for u in sets], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())], names=["cid", "tokens"])

    found = docs.select("doc_id", "text").join(few, "doc_id").select("cid", "text").mapInArrow(run, "cid long, tokens binary")
    if not few.where("doc_id IS NULL").isEmpty():
        nulls = docs.where("doc_id IS NULL").select("text").mapInArrow(without_id, "cid long, tokens binary")
        found = found.unionByName(nulls.join(few.where("doc_id IS NULL").select("cid"), "cid"))
    out = tables.table(found.dropDuplicates(["cid"]), "sets")
    tables.drop(few)
    return out


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, tables: Scratch, s: JoinSettings) -> DataFrame:
    """A table of the pairs (a, b) whose token sets, read from the documents, are similar enough."""
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    sets = token_sets(docs, wanted, classes, tables, s)
    out = tables.table(verified(pairs, sets, s), "links")
    tables.drop(sets)
    return out


def sketch_filter(pairs: DataFrame, classes: DataFrame, s: JoinSettings) -> DataFrame:
    """The pairs (a, b) whose bit sketches do not differ too much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, x, nb, y in zip(*(b.column(c).to_pylist() for c in ("na", "sa", "nb", "sb")), strict=True):
                keep.append(hamming(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) <= s.differences(na, nb))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    few = classes.select("cid", "n", "sketch")
    first = pairs.join(few, F.col("a") == F.col("cid")).select("a", "b", F.col("n").alias("na"), F.col("sketch").alias("sa"))
    both = first.join(few, F.col("b") == F.col("cid")).select("a", "b", "na", "sa", F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return both.mapInArrow(run, "a long, b long")


_TILE = ["bucket", "i", "j", "g", "cid", "n", "component"]


def _sketch_rows(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Words of each sketch; the sketches of each width as a matrix; and each sketch's row in its matrix."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype="<u8")
    words = pc.binary_length(column).to_numpy() // 8
    first = np.cumsum(words) - words
    place, by_width = np.zeros(len(words), dtype=np.int64), {}
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        by_width[w] = raw[first[own][:, None] + np.arange(w)]
        place[own] = np.arange(len(own))
    return words, by_width, place


def _near_rows(i: np.ndarray, j: np.ndarray, n: np.ndarray, sketches: tuple, s: JoinSettings) -> np.ndarray:
    """Which pairs of rows (i, j) differ in no more bits than their sizes allow."""
    words, by_width, place = sketches
    most = (n[i] + n[j]) * (s.den - s.num) // (s.den + s.num)
    ok = np.zeros(len(i), dtype=bool)
    wx, wy = words[i], words[j]
    for a in by_width:
        for b in by_width:
            of = np.flatnonzero((wx == a) & (wy == b))
            w = min(a, b)
            for k in range(0, len(of), 1 << 16):
                x = of[k : k + (1 << 16)]
                left, right = (by_width[v][place[y[x]]].reshape(len(x), -1, w) for v, y in ((a, i), (b, j)))
                gap = np.bitwise_xor.reduce(left, axis=1) ^ np.bitwise_xor.reduce(right, axis=1)  # folding
                ok[x] = np.bitwise_count(gap).sum(axis=1) <= most[x]
    return ok


def cross_pairs(members: DataFrame, forest: bool, s: JoinSettings) -> DataFrame:
    """Pairs (a, b) to verify among members (bucket, cid, n, component, sketch, m) of m rows to a bucket.

    They lie in different components and their bit sketches allow a link.  ``forest``: a task leaves out
    pairs between components that its earlier pairs have joined.  A bucket of more than ``tile`` members is
    cut into groups, and each pair of groups is a tile of its own, so that no task compares more than
    ``tile`` rows with as many; rows are compared in numpy and no pair is a row before it has passed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
            bucket, ti, tj, g, cid, n, comp = (t.column(c).to_numpy() for c in _TILE)
            sketches = _sketch_rows(t.column("sketch").combine_chunks())
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])])
            end = np.append(np.flatnonzero(new)[1:], len(bucket))[np.cumsum(new) - 1]
            ahead = end - np.arange(len(bucket)) - 1  # rows behind each row in its tile
            total, at = np.cumsum(ahead), 0
            while at < len(bucket):
                stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 2_000_000, side="right")))
                i = np.repeat(np.arange(at, stop), ahead[at:stop])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(ahead[at:stop]) - ahead[at:stop], ahead[at:stop])
                ok = (comp[i] != comp[j]) & (cid[i] != cid[j]) & ((g[i] != g[j]) | (ti[i] == tj[i]))
                ok &= s.den * np.minimum(n[i], n[j]) >= s.num * np.maximum(n[i], n[j])
                i, j = i[ok], j[ok]
                ok = _near_rows(i, j, n, sketches, s)
                i, j, at = i[ok], j[ok], stop
                pair = np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])])
                pair, first = np.unique(pair, axis=1, return_index=True)
                if forest and len(first):
                    keep = []
                    for k, (x, y) in enumerate(zip(comp[i[first]].tolist(), comp[j[first]].tolist(), strict=True)):
                        x, y = find(x), find(y)
                        if x != y:
                            root[max(x, y)] = min(x, y)
                            keep.append(k)
                    pair = pair[:, keep]
                if pair.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

        rest: pa.Table | None = None  # the last tile so far
        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            key = [t.column(c).to_numpy() for c in _TILE[:3]]
            other = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from pairs_of(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from pairs_of(rest)

    groups = F.ceil(F.col("m") / F.lit(s.tile)).cast("int")
    cut = members.withColumn("t", groups).withColumn("g", F.pmod(F.xxhash64("cid"), F.col("t")).cast("int"))
    dealt = cut.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    dealt = dealt.select("bucket", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), "g", "cid", "n", "component", "sketch")
    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cid").mapInArrow(run, "a long, b long").distinct()


def class_links(docs: DataFrame, classes: DataFrame, frequent: np.ndarray, tables: Scratch, s: JoinSettings = JoinSettings()) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) between classes that connect all similar classes (a spanning part of all links).

    ``classes`` holds cid, n, sketch and the least doc_id of each class.  Beside the links come their
    components, where the last round found no link after them.
    """
    found = tables.table(candidates(docs, frequent, s), "candidates")
    edges = sketch_filter(found.where("kind = 1").select("a", "b").distinct(), classes, s)
    edges = tables.table(edges, "pairs")
    members = found.where("kind = 2").select(F.col("a").alias("cid"), F.col("na").alias("n"), F.col("b").alias("bucket")).distinct()
    wide = members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 2").select("bucket")  # the star of two is their only pair
    members = tables.table(members.join(wide, "bucket"), "wide-buckets")
    tables.drop(found)
    links, tried = verify(edges, docs, classes, tables, s), edges
    for turn in range(s.forest_rounds + 1):
        forest = turn < s.forest_rounds
        comps = connected_components(links, "a", "b")
        placed = tables.table(members.join(comps.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", "n", F.coalesce("component", "cid").alias("component")), "members")
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("bucket", "m")
        open_rows = placed.join(mixed, "bucket").join(classes.select("cid", "sketch"), "cid")
        found = tables.table(cross_pairs(open_rows, forest, s), "open-pairs")
        tables.drop(placed)
        pairs = tables.table(found.join(tried, ["a", "b"], "left_anti"), "new-pairs", False)
        n_found, n_new = found.count(), 0
        tables.drop(found)
        if not pairs.isEmpty():
            new = verify(pairs, docs, classes, tables, s)
            n_new = new.count()
            more = tables.table(links.unionByName(new), "links", False)
            tables.drop(links, new)
            links = more
        if n_new == n_found:  # what a forest joins is linked, so nothing is left between its components
            tables.drop(pairs)
            break
        if turn < s.forest_rounds:
            more = tables.table(tried.unionByName(pairs), "tried", False)
            tables.drop(tried)
            tried = more
        tables.drop(pairs)
    tables.drop(members, tried)
    return links, comps if n_new == 0 else None


def near_duplicates(docs: DataFrame, s: JoinSettings = JoinSettings()) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document.

    Null, empty and blank texts have no shingles and are linked with nothing: their component is their
    own id.  Texts with equal shingle sets are linked whatever their texts are.  Rows that repeat a
    doc_id are kept, each with its own shingles; as documents they are one node per shingle set.  A null
    doc_id never names a component of others; alone, its component is null.  No rows give no rows.
    """
    ship_package(docs.sparkSession)
    tables = Scratch(docs.sparkSession)
    surveyed = tables.table(survey(docs, s=s), "survey")
    frequent = frequent_tokens(surveyed, s)
    rows = materialise(surveyed.where("kind = 0").select("doc_id", "n_shingles", "cid"), "rows")
    full = surveyed.where("kind = 0 and cid <> 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    classes = tables.table(full, "classes")
    tables.drop(surveyed)
    # A document of several sets (a repeated id) connects them.
    many = rows.where("cid <> 0 and doc_id is not null").groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b")
    same = rows.where("cid <> 0").join(many.select("doc_id", "a"), "doc_id").select("a", F.col("cid").alias("b")).where("a <> b")
    links, comps = class_links(docs, classes, frequent, tables, s)
    if comps is None or not many.isEmpty():
        comps = connected_components(links.unionByName(same), "a", "b")
    named = tables.table(classes.join(comps.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "doc_id", F.coalesce("component", "cid").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    lookup = materialise(named.join(least, "component").select("cid", "component_id"), "lookup")
    tables.drop(named, links, classes)
    return rows.join(lookup, "cid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
