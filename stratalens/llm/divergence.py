"""How far the sources of a language diverge from each other, and by which terms.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased.  Each language keeps the terms of
at least ``min_docs`` of its documents.  A group (language, source), or a language, gives a kept term the
share ``1 + floor(SCALE * (count + 1) / (N + V))``; the divergence of shares p and q is ``(p - q)**2 // q``.

1. Tasks count the terms of their documents, a dictionary for each group at a time, and hand on sums.
2. Sums meet by (language, term, source), then by (language, term), where rare terms go.
3. The kept terms of a language are dealt to blocks of about ``block`` terms.  A block becomes a dense int64
   tile of groups by terms, absent counts included; all pairs of groups of a tile are computed at once by
   broadcasting, a slice of terms at a time, and its pair matrix is added to that of the earlier tiles of the
   task.  Each group keeps its best terms in a bounded heap.
   ``_RUN`` blocks that follow one another stay together, so that what the tasks hand on grows with the kept
   terms and not with the number of tasks that they are dealt to.
4. The pair matrices of the tasks are summed, and their heaps are merged by rank.

A language with many sources is cut further, into blocks of sources that meet pair by pair, so that a tile
holds at most about ``2 * sources`` groups.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, ship_package, trim

SCALE = 1_000_000_000
#: Distinct terms that a task counts before it hands them on, and values of a tile that are broadcast at once.
_HELD, _AT_ONCE = 400_000, 1 << 18
#: Rows of languages or groups up to which they are sent to every task; beyond, the join shuffles.
_SENT = 20_000
#: Blocks of a language that one task computes and sums.
_RUN = 8

#: ASCII letters lower-cased, other ASCII characters blank, the bytes of other characters as they are.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split(b" ") if text else []


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial sums; ``docs`` counts the documents that hold the term."""
    ship_package(docs.sparkSession)

    def rows(group: tuple[bytes, bytes], n: Counter, seen: Counter) -> pa.RecordBatch:
        keys = list(n)
        lang, source = (pa.array([g.decode()] * len(keys), pa.string()) for g in group)
        return pa.RecordBatch.from_arrays([lang, source, pa.array(keys, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for text, lang, source in zip(*(c.cast(pa.binary()).to_pylist() for c in b.columns), strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                found = Counter(terms(text))
                found.pop(b"", None)
                size -= len(n)
                n.update(found)
                seen.update(found.keys())
                size += len(n)
                if size > _HELD:
                    for g, (n, seen) in held.items():
                        yield rows(g, n, seen)
                    held, size = {}, 0
        for g, (n, seen) in held.items():
            yield rows(g, n, seen)
        held.clear()
        trim()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return docs.select(*named).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / total)`` by long division in steps of 1000, exact for totals below 9e15."""
    top = count + 1
    whole, rest = top // total, top % total
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // total
        rest %= total
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``(p - q)**2 // q``; shares are at most SCALE + 1, so that squares stay below 2**63."""
    d = p - q
    d *= d
    d //= q
    return d


class _Task:
    """Pair matrices and heaps of the tiles that one task has met."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.pairs: dict[tuple[str, str, str], int] = {}
        self.heaps: dict[tuple[str, str], list[tuple[int, "_Last"]]] = {}

    def add(self, lang: str, here: bool, groups: list[tuple[str, int, bool, bool]], v: int, n_lang: int, names: list[str], totals: np.ndarray, at: np.ndarray, term: np.ndarray, n: np.ndarray) -> None:
        """``groups``: (source, N, it is a row, it is a column); counts n[k] of terms[term[k]] in groups[at[k]].

        ``here``: the terms of the row groups are ranked in this tile.
        """
        tile = np.zeros((len(groups), len(names)), dtype=np.int64)
        tile[at, term] = n
        total = np.array([g[1] for g in groups], dtype=np.int64)[:, None] + v
        p = share(tile, total)
        rows, cols = (np.flatnonzero([g[k] for g in groups]) for k in (2, 3))
        sums = np.zeros((len(rows), len(cols)), dtype=np.int64)
        width = max(1, _AT_ONCE // max(1, len(rows) * len(cols)))
        for lo in range(0, len(names), width):
            part = p[:, lo : lo + width]
            sums += divergence(part[rows][:, None, :], part[cols][None, :, :]).sum(axis=2)
        for i, r in enumerate(rows):
            for j, c in enumerate(cols):
                if r != c:
                    key = (lang, groups[r][0], groups[c][0])
                    self.pairs[key] = self.pairs.get(key, 0) + int(sums[i, j])
        if here and len(names):
            q = share(totals, n_lang + v)
            for r in rows:
                value = np.where((tile[r] > 0) & (p[r] > q), divergence(p[r], q), -1)
                some = np.flatnonzero(value >= 0)
                if len(some) > self.top:  # ties at the border are all kept, the heap decides
                    some = some[value[some] >= np.partition(value[some], -self.top)[-self.top]]
                heap = self.heaps.setdefault((lang, groups[r][0]), [])
                for k in some.tolist():
                    item = (int(value[k]), _Last(names[k]))
                    if len(heap) < self.top:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)

    def rows(self) -> pa.RecordBatch:
        out = [(lang, a, "pair", b, v) for (lang, a, b), v in self.pairs.items()]
        out += [(lang, a, "term", t.name, v) for (lang, a), heap in self.heaps.items() for v, t in heap]
        self.pairs, self.heaps = {}, {}
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "source", "part", "item", "value"])


class _Last:
    """A name that is the greater the earlier it stands in code point order, which is that of UTF-8."""

    __slots__ = ("name",)

    def __init__(self, name: str) -> None:
        self.name = name

    def __lt__(self, other: _Last) -> bool:
        return self.name > other.name

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Last) and self.name == other.name


#: A row of a tile: a group (kind 0) with N, V and the N of its language, or a count (kind 1) with the term's total.
_ROW = ("lang", "block", "i", "j", "kind", "source", "term", "n", "total", "v", "side")


def _tiles(batches: Iterator[pa.RecordBatch], top: int, held_pairs: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, groups before counts."""
    task, key, parts = _Task(top), None, []

    def close() -> None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        kind = rows["kind"].to_numpy()
        cut = int(np.searchsorted(kind, 1))
        side = rows["side"].to_numpy()
        sources, ns = rows["source"].slice(0, cut).to_pylist(), rows["n"].slice(0, cut).to_pylist()
        sides: dict[str, list] = {}
        for s, n, k in zip(sources, ns, side[:cut].tolist(), strict=True):
            g = sides.setdefault(s, [s, n, False, False])
            g[2] |= k != 1
            g[3] |= k != 0
        place = {s: i for i, s in enumerate(sides)}
        _, _, i, j = key
        own = rows.slice(cut)
        names = own["term"].combine_chunks().dictionary_encode()
        at = np.array([place[s] for s in own["source"].to_pylist()], dtype=np.int64)
        term = names.indices.to_numpy()
        totals = np.zeros(len(names.dictionary), dtype=np.int64)
        totals[term] = own["total"].to_numpy()
        first = rows.slice(0, 1).to_pylist()[0]
        task.add(key[0], i == j, [tuple(g) for g in sides.values()], first["v"], first["total"], names.dictionary.to_pylist(), totals, at, term, own["n"].to_numpy())

    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(b.column(c).to_pylist() for c in _ROW[:4]), strict=True))
        lo = 0
        while lo < len(keys):
            hi, here = lo + 1, keys[lo]
            if keys[-1] == here:
                hi = len(keys)
            else:
                while keys[hi] == here:
                    hi += 1
            if here != key and parts:
                close()
                parts = []
                if len(task.pairs) > held_pairs:
                    yield task.rows()
            key = here
            parts.append(b.slice(lo, hi - lo))
            lo = hi
    if parts:
        close()
    yield task.rows()
    trim()


def _sent(df: DataFrame) -> DataFrame:
    """``df`` to every task if it is counted to be small; otherwise as it is."""
    return F.broadcast(df) if df.limit(_SENT + 1).count() <= _SENT else df


def _pairs_of(block: Column, blocks: Column) -> Column:
    """(i, j, side) of all tiles in which a source of this block stands: as a row (0), a column (1) or both (2)."""
    every = F.sequence(F.lit(0), blocks - 1)
    as_row = F.transform(F.filter(every, lambda k: k != block), lambda k: F.struct(block.alias("i"), k.alias("j"), F.lit(0).alias("side")))
    as_col = F.transform(F.filter(every, lambda k: k != block), lambda k: F.struct(k.alias("i"), block.alias("j"), F.lit(1).alias("side")))
    return F.concat(F.array(F.struct(block.alias("i"), block.alias("j"), F.lit(2).alias("side"))), as_row, as_col)


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, block: int = 512, sources: int = 128) -> DataFrame:
    """lang, source, part, item, value and rank: ``pair`` rows for every other source, ``term`` rows for the best terms.

    Null text, lang and source count as ''.  Every group that occurs has its pairs, also without terms; without
    kept terms their value is 0.  Equal values go by item.  Repeated rows count as documents of their own.  An
    empty table gives no rows.  Other columns are left out.
    """
    tables = Scratch(docs.sparkSession)
    summed = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    each = summed.withColumn("df", F.sum("docs").over(same)).withColumn("total", F.sum("n").over(same)).withColumn("lead", F.col("source") == F.min("source").over(same))
    kept = tables.table(each.where(F.col("df") >= min_docs).select("lang", "term", "source", "n", "total", "lead"), "terms", False)
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("lead").cast("long")).alias("v"))
    groups = tables.table(occurring.join(of_group, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "groups", False)
    langs = tables.table(
        groups.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("n").alias("n_lang"), F.greatest(F.lit(1), F.ceil(F.sum("v") / block)).cast("int").alias("blocks"), F.ceil(F.count("*") / sources).cast("int").alias("parts")),
        "languages", False,
    )
    few = _sent(langs)
    part = F.pmod(F.xxhash64("source"), F.col("parts")).cast("int")
    group_rows = (
        groups.select("lang", "source", "n").join(few, "lang").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("own"))
        .select("lang", "block", F.inline(_pairs_of(F.col("own"), F.col("parts"))), "source", F.lit("").alias("term"), "n", F.col("n_lang").alias("total"), "v", F.lit(0).alias("kind"))
    )
    count_rows = (
        kept.join(few, "lang").select("*", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), part.alias("own"))
        .select("lang", "block", F.inline(_pairs_of(F.col("own"), F.col("parts"))), "source", "term", "n", "total", "v", F.lit(1).alias("kind"))
    )
    rows = group_rows.select(*_ROW).unionByName(count_rows.select(*_ROW))
    dealt = rows.repartition("lang", F.floor(F.col("block") / _RUN), "i", "j").sortWithinPartitions("lang", "block", "i", "j", "kind")
    partial = dealt.mapInArrow(lambda batches: _tiles(batches, top), "lang string, source string, part string, item string, value long")
    found = tables.table(partial, "tiles", False)
    tables.drop(kept, groups, langs)
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = found.where("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(best).alias("rank")).where(F.col("rank") <= top)
    return pairs.select("lang", "source", "part", "item", "value", F.row_number().over(best).alias("rank")).unionByName(ranked)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 each AS (SELECT r, lang, source, unnest(w) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS total FROM each GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
 counts AS (SELECT lang, source, term, count(*) AS c FROM each GROUP BY ALL),
 grp AS (SELECT DISTINCT lang, source FROM d),
 lv AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
 dense AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.c, 0) AS c FROM grp g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
 shares AS (SELECT lang, source, term, c,
   CAST(1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + v) AS HUGEINT) AS p,
   CAST(1 + (1000000000::HUGEINT * (total + 1)) // (n + v) AS HUGEINT) AS q FROM dense JOIN lv USING (lang)),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
   FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
   FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
 best AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM best) QUALIFY part = 'pair' OR rank <= 200
"""
