"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (all its words, if it has fewer).  The
fingerprint of a full window is the least hash of its k-word grams, so a span of ``window`` words that
stands in both texts has the same fingerprint in both: documents and items are joined on fingerprints
and no shared span of that length can be missed.  A fingerprint that meets is extended to the words of
its windows and compared with the items' windows word by word, so hash collisions have no effect.  Items
shorter than a window are their own fingerprint.

Fingerprints are taken of wholly lower-cased words, because ``lower`` is much faster than the
lower-casing of A-Z alone: it cuts the same words and never parts equal ones, and what it lets through
in excess falls in the comparison.  Each text is cut once; that pass gives the number of words as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise

#: Fixed values of the contract: what a word is, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows of one or two 64-bit numbers that are broadcast; beyond it the join is by shuffle.
BROADCAST_ROWS = 500_000


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def _coarse_words(text: Column) -> Column:
    """The same words in the same number and order, but other letters than A-Z are lower-cased too."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _runs(array: Column, length: int) -> Column:
    """The starts 1, 2, ... of all runs of ``length`` elements.

    Reading the array's size here and its elements in a lambda makes two references, so the optimiser
    never moves the array's own expression into the lambda, where it would be evaluated per element.
    """
    n = F.size(array)
    return F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _gram_hashes(h: Column, k: int) -> Column:
    return F.transform(_runs(h, k), lambda i: F.xxhash64(F.slice(h, i, k)))


def _fingerprints(df: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """Adds ``m<window>``, the fingerprint of every full window of ``h``, and ``m<l>`` for each short length."""
    df = df.withColumn("g", _gram_hashes(F.col("h"), k))
    df = df.withColumn(f"m{window}", F.transform(_runs(F.col("g"), window - k + 1), lambda i: F.array_min(F.slice("g", i, window - k + 1)))).drop("g")
    for length in short:
        df = df.withColumn(f"m{length}", _gram_hashes(F.col("h"), length))
    return df


def _narrow(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def _span_key(span: Column) -> list[Column]:
    """Two hashes of a span, by which long spans are joined before they are compared."""
    return [F.xxhash64(span).alias("k1"), F.xxhash64(F.lit(1), span).alias("k2")]


def item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """item_id, len, span, mark, k1, k2 of every window of every item, each once."""
    it = items.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - (window - 1), F.lit(1))), lambda i: F.slice("w", i, window))
    spans = it.select("item_id", F.explode(spans).alias("s"))
    spans = spans.withColumn("h", F.transform("s", lambda x: F.xxhash64(F.lower(x)))).withColumn("span", F.array_join("s", " "))
    mark = F.when(F.size("s") == window, F.array_min(_gram_hashes(F.col("h"), k))).otherwise(F.xxhash64("h"))
    return spans.select("item_id", F.size("s").alias("len"), "span", mark.alias("mark"), *_span_key(F.col("span"))).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Null text has no words.  An item without words has no window.  Rows of ``docs`` are kept one to one;
    rows that share doc_id and text are counted on their own.  A null doc_id is a value like others.
    Items with the same id and text count once; a null item_id is left out of the items of a document
    but its windows hit.  An empty benchmark hits nothing; other columns are ignored.
    """
    text_hash = F.xxhash64("text")
    wins = materialise(item_windows(items, window, k), "item-windows")
    short = sorted(r["len"] for r in wins.where(F.col("len") < window).select("len").distinct().collect())  # at most window - 1 lengths
    marks = wins.select("mark").distinct()
    lengths = [window, *short]

    # One pass: each row of docs gives a row of its own (pos 0) and its distinct fingerprints.
    prints = docs.select("doc_id", text_hash.alias("th"), _coarse_words(F.col("text")).alias("w")).withColumn("h", _hashes(F.col("w")))
    prints = _fingerprints(prints.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), "h"), window, k, short)
    own = F.array(F.xxhash64("doc_id", "th"))
    every = F.concat(own, F.array_distinct(F.concat(*[F.col(f"m{x}") for x in lengths])))
    told = prints.select("doc_id", "th", "n_words", F.posexplode(every).alias("pos", "mark"))
    told = told.join(_narrow(marks.withColumn("known", F.lit(True)), marks.count()), "mark", "left").where("pos = 0 or known")
    met = F.collect_set(F.when(F.col("pos") > 0, F.col("mark")))
    base = materialise(told.groupBy("doc_id", "th").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("pos") == 0).alias("rows"), met.alias("marks")), "documents-met")

    # Extend: the windows at places whose fingerprint met, compared word by word.
    wanted = base.where(F.size("marks") > 0).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "marks")
    few = docs.select("doc_id", text_hash.alias("th"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    few = few.select("doc_id", "th", "marks", words(F.col("text")).alias("w"), _coarse_words(F.col("text")).alias("c")).withColumn("h", _hashes(F.col("c"))).drop("c")
    few = _fingerprints(few, window, k, short)

    def places_of(length: int) -> DataFrame:
        at = F.filter(_runs(F.col(f"m{length}"), 1), lambda i: F.array_contains("marks", F.element_at(f"m{length}", i)))
        spans = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), F.array_join(F.slice("w", i, length), " ").alias("span")))
        return few.select("doc_id", "th", F.explode(spans).alias("h")).select("doc_id", "th", "h.*")

    found = reduce(DataFrame.unionByName, map(places_of, lengths)).select("*", *_span_key(F.col("span")))
    keys = wins.select("k1", "k2").distinct()
    found = found.join(_narrow(keys, keys.count()), ["k1", "k2"], "left_semi")
    hits = materialise(found.join(wins.select("span", "k1", "k2").distinct().hint("shuffle_hash"), ["k1", "k2", "span"], "left_semi"), "hits")
    # Rows that repeat a text repeat its hits; the union of the places is the same.
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("at", "len"))),
        F.struct(F.lit(1).alias("free"), F.lit(0).cast("long").alias("n")),
        lambda acc, h: F.struct(F.greatest(acc["free"], h["at"] + h["len"]).alias("free"), (acc["n"] + F.greatest(F.lit(0), h["at"] + h["len"] - F.greatest(acc["free"], h["at"]))).cast("long").alias("n")),
        lambda acc: acc["n"],
    )
    n_hit = hits.groupBy("doc_id", "th").agg(covered.alias("n_hit"))
    owners = wins.where("item_id is not null").select("k1", "k2", F.col("item_id").cast("string").alias("item")).distinct()
    pairs = hits.select("doc_id", "th", "k1", "k2").distinct().join(owners, ["k1", "k2"]).select("doc_id", "th", "item").distinct()
    named = pairs.groupBy("doc_id", "th").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    seen = n_hit.withColumnsRenamed({"doc_id": "d", "th": "t"}).join(named, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")), "left").select("d", "t", "n_hit", "n_items", "items_sha256")
    out = base.drop("marks").join(seen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    out = out.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"))


#: The same for DuckDB, from the windows alone.
ORACLE = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS span
         FROM iw, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dwin AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS span FROM dw, (SELECT DISTINCT l FROM iwin), unnest(range(1, len(w) - l + 2)) AS r(i)),
hits AS (SELECT doc_id, i, iwin.l, item_id FROM dwin JOIN iwin ON dwin.span = iwin.span AND dwin.l = iwin.l),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + l)) AS r(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
