"""Similarity: vector search, TF-IDF, hashed bags of words, clones, density clusters, import graphs."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.text import lines


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, threshold: float = 0.6, vid: str = "vec_id", vec: str = "embedding", block: int = 1 << 20) -> DataFrame:
    """query_id, vec_id, similarity: the ``k`` most similar corpus vectors per query at or above ``threshold``.

    The query set is stated and small: it is sent to the tasks as a matrix, the corpus passes by in
    Arrow batches.  A task compares ``block`` pairs at once and keeps its k best per query, whatever number
    of pairs reaches the threshold, and one grouped top-k joins the tasks.  Equal similarities go by id.
    """
    q = queries.select(vid, vec).toPandas()
    ids = q[vid].to_numpy()
    m = np.array(q[vec].tolist(), dtype=np.float64).reshape(len(ids), -1)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if len(ids) else 1.0

    def best_of(s: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of each row of ``s`` (-inf: none), columns in the order of their ids."""
        n = min(k, s.shape[1])
        least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        order = np.lexsort((c, -s[r, c], r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, c, place = r[place < n], c[place < n], place[place < n]
        value, name = np.full((len(s), k), -np.inf), np.zeros((len(s), k), dtype=own.dtype)
        value[r, place], name[r, place] = s[r, c], own[c]
        return value, name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value, name = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)
        for b in batches:
            if not len(b) or not len(ids):
                continue
            b = b.sort_values(vid)
            x = np.array(b[vec].tolist(), dtype=np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            own = b[vid].to_numpy()
            name = name.astype(np.result_type(name, own), copy=False)
            step = max(1, block // len(own))
            for i in range(0, len(ids), step):
                s = m[i : i + step] @ x.T
                s[~(s >= threshold) | (ids[i : i + step, None] == own[None])] = -np.inf
                v, w = (np.concatenate(z, axis=1) for z in zip((value[i : i + step], name[i : i + step]), best_of(s, own), strict=True))
                order = np.lexsort((w, -v), axis=-1)[:, :k]
                value[i : i + step], name[i : i + step] = np.take_along_axis(v, order, 1), np.take_along_axis(w, order, 1)
        r, c = np.nonzero(value > -np.inf)
        yield pd.DataFrame({"query_id": ids[r], vid: name[r, c], "similarity": value[r, c]})

    best = corpus.select(vid, vec).mapInPandas(run, f"query_id long, {vid} long, similarity double")
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col(vid).alias("v")))), 1, k)
    return best.groupBy("query_id").agg(ordered.alias("t")).select("query_id", F.explode("t").alias("t")).select("query_id", F.col("t.v").alias(vid), (-F.col("t.s")).alias("similarity"))


def terms(docs: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """doc_id, term, tf: words of ``least`` ASCII letters or more, lower-cased."""
    t = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"[a-z]{{{least},}}"), F.lit(0))).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def tfidf(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, term, weight = tf * ln(N / df)."""
    t = terms(docs, text)
    n = docs.agg(F.count("*").alias("n_docs"))
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    return t.join(df, "term").join(n).select("doc_id", "term", (F.col("tf") * F.log(F.col("n_docs") / F.col("df"))).alias("weight"))


def _block_terms(known: pa.Array, least: int) -> Callable[[pa.Table], tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """Of a block of texts in lower case that end in a blank: the ids in their order, then of each word document, letters and place in ``known`` (or -1)."""

    def words(text: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        """Row and letters of each run of ``least`` ASCII letters or more."""
        t = text.cast(pa.large_string()).combine_chunks()
        ends = np.frombuffer(t.buffers()[1], dtype=np.int64)[t.offset : t.offset + len(t) + 1]
        b = np.frombuffer(t.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
        letter = (b >= 97) & (b <= 122)
        turns = np.flatnonzero(np.diff(letter, prepend=False))
        first, size = turns[::2], turns[1::2] - turns[::2]
        for i in range(least - 1):
            letter[first[(size < least) & (size > i)] + i] = False
        first, size = first[size >= least], size[size >= least]
        to = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return np.searchsorted(ends - ends[0], first, side="right") - 1, pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(to), pa.py_buffer(b[letter]))

    def read(t: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
        code = t["doc_id"].combine_chunks().dictionary_encode("encode")
        order = pc.sort_indices(code.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        row, found = words(t["text"])
        return code.dictionary.take(pa.array(order)), rank[code.indices.to_numpy()[row]], found, pc.index_in(found, value_set=known).fill_null(-1).to_numpy().astype(np.int64)

    return read


def tfidf_search(docs: DataFrame, query_ids: list[int], k: int = 5, threshold: float = 0.3, text: str = "text", block: int = 1 << 22, pairs: int = 1 << 18, share: int = 1 << 25) -> DataFrame:
    """query_id, doc_id, similarity by cosine of the vectors of ``tfidf``, for a stated set of queries.

    The terms of the queries, with the number of documents of each, and their weights are sent to the tasks.
    If the texts of the queries have more than ``share`` bytes, the queries go by in rounds of about that size,
    each over all documents and written before the next, so that the driver holds one of them.
    Documents are dealt to blocks of about ``block`` bytes; a task takes the products of ``pairs`` pairs at once,
    so that pairs are rows only when they are among the k best of a query in a block.  Terms that no query has
    add to the lengths of the vectors alone and are counted by a shuffle.  Every pair is computed; terms
    that are common on both sides go by a dense product, which changes no result.
    """
    octets, query_ids = F.octet_length(text), list(dict.fromkeys(query_ids))
    n, size, asked = docs.agg(F.count("*"), F.sum(octets), F.sum(F.when(F.col("doc_id").isin(query_ids), octets))).first()
    rounds = max(1, -(-(asked or 0) // share))
    parts = (_tfidf_round(docs, query_ids[i::rounds], k, threshold, text, n, max(8, -(-(size or 0) // block)), pairs) for i in range(rounds))
    if rounds == 1:
        return next(parts)
    from ..streaming.store import shared_folder  # which reads other operators itself

    spark = docs.sparkSession
    path = shared_folder(spark, "tfidf")
    for i, part in enumerate(parts):
        part.write.parquet(f"{path}/{i}")
        schema, part = part.schema, None
        for _ in range(2):  # Spark deletes the shuffle files of a round when the driver has let go of its plan
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.05)
    return spark.read.schema(schema).parquet(*[f"{path}/{i}" for i in range(rounds)])


def _tfidf_round(docs: DataFrame, query_ids: list[int], k: int, threshold: float, text: str, n: int, blocks: int, pairs: int) -> DataFrame:
    least, kind = 3, docs.schema["doc_id"].dataType.simpleString()
    q = terms(docs.where(F.col("doc_id").isin(query_ids)), text, least).toArrow()
    vocabulary, ids = (pc.unique(q[c]).sort() for c in ("term", "doc_id"))
    known = vocabulary.cast(pa.large_string())
    b = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    d = docs.where(F.col(text).isNotNull()).select(b, "doc_id", F.concat(F.lower(F.col(text)), F.lit(" ")).alias("text"))
    read = _block_terms(known, least)

    def count(t: pa.Table) -> pa.Table:
        _, doc, _, place = read(t)
        key = np.unique(doc[place >= 0] * len(known) + place[place >= 0])
        m = np.bincount(key % max(1, len(known)), minlength=len(known))
        return pa.table({"place": np.flatnonzero(m), "n": m[m > 0]})

    def others(t: pa.Table) -> pa.Table:
        found, doc, words, place = read(t)
        rows = pa.table({"doc": doc[place < 0], "term": words.filter(place < 0)}).group_by(["doc", "term"]).aggregate([([], "count_all")])
        first = pa.repeat(t["block"][0], len(rows))
        return pa.table({"block": first, "doc_id": found.take(rows["doc"].combine_chunks()), "term": rows["term"].cast(pa.string()), "tf": rows["count_all"]})

    at = d.groupBy("block").applyInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    df = np.ones(len(vocabulary))
    df[at["place"].to_numpy()] = at["n"].to_numpy()
    idf = np.log(n / df)
    who, what = (pc.index_in(q[c], value_set=v).to_numpy() for c, v in (("doc_id", ids), ("term", vocabulary)))
    order = np.lexsort((who, what))
    who, what = who[order].astype(np.int32), what[order]
    much = q["tf"].to_numpy()[order] * idf[what]
    length = np.sqrt(np.bincount(who, much * much, minlength=len(ids)))
    much /= np.where(length > 0, length, 1.0)[who]
    start = np.searchsorted(what, np.arange(len(vocabulary) + 1))
    share = df * np.diff(start) / max(1, n * len(ids))
    often = np.argsort(-share, kind="stable")[: min(1024, int((share > 1 / 256).sum()))]
    made: list[np.ndarray] = []  # once per task

    def dense() -> np.ndarray:
        if not made:
            m = np.zeros((len(often), len(ids)))
            for i, v in enumerate(often):
                m[i, who[start[v] : start[v + 1]]] = much[start[v] : start[v + 1]]
            made.append(m)
        return made[0]

    column = np.full(len(vocabulary), -1)
    column[often] = np.arange(len(often))
    many = np.diff(start)

    def products(doc: np.ndarray, place: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """Rows of documents by columns of queries."""
        c = column[place]
        x = np.zeros((rows, len(often)))
        x[doc[c >= 0], c[c >= 0]] = weight[c >= 0]
        doc, place, weight = doc[c < 0], place[c < 0], weight[c < 0]
        m = many[place]
        to = np.arange(m.sum()) + np.repeat(start[place] - (np.cumsum(m) - m), m)
        s = np.bincount(np.repeat(doc * len(ids), m) + who[to], np.repeat(weight, m) * much[to], minlength=rows * len(ids))
        return x @ dense() + s.reshape(rows, len(ids))

    def first_k(query: np.ndarray, doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        o = np.lexsort((doc, -s, query))
        query, doc, s = query[o], doc[o], s[o]
        keep = np.arange(len(o)) - np.searchsorted(query, query) < k
        return query[keep], doc[keep], s[keep]

    def best(t: pa.Table, rest: pa.Table) -> pa.Table:
        none = np.zeros(0, dtype=np.int64)
        found, doc, _, place = read(t) if len(t) else (t["doc_id"].combine_chunks(), none, None, none)
        key, tf = np.unique(doc[place >= 0] * len(known) + place[place >= 0], return_counts=True)
        doc, place = np.divmod(key, max(1, len(known)))
        weight = tf * idf[place]
        square = np.bincount(doc, weight * weight, minlength=len(found)).astype(np.float64)  # counts, if there is nothing to add
        square[pc.index_in(rest["doc_id"], value_set=found).to_numpy()] += rest["square"].to_numpy()
        weight /= np.sqrt(np.where(square > 0, square, 1.0))[doc]
        own = pc.index_in(found, value_set=ids).fill_null(-1).to_numpy()
        top = (none, none, np.zeros(0))
        step = max(1, pairs // max(1, len(ids)))
        for lo in range(0, len(found) if len(ids) else 0, step):
            hi = min(lo + step, len(found))
            i, j = np.searchsorted(doc, (lo, hi))
            s = products(doc[i:j] - lo, place[i:j], weight[i:j], hi - lo)
            mine = np.flatnonzero(own[lo:hi] >= 0)
            s[mine, own[lo:hi][mine]] = 0.0
            r, c = np.nonzero((s >= threshold) & (s > 0))
            if len(r):
                top = first_k(*(np.concatenate(z) for z in zip(top, (c, r + lo, np.floor(s[r, c] * 1e6 + 0.5) / 1e6), strict=True)))
        return pa.table({"query_id": ids.take(top[0]), "doc_id": found.take(top[1]), "similarity": top[2]}).filter(pc.field("doc_id").is_valid())

    rows = d.groupBy("block").applyInArrow(others, f"block int, doc_id {kind}, term string, tf long")
    w = F.col("tf") * F.log(F.lit(n) / F.count("*").over(Window.partitionBy("term")))
    rest = rows.select("block", "doc_id", (w * w).alias("w")).groupBy("block", "doc_id").agg(F.sum("w").alias("square"))
    near = d.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(best, f"query_id {kind}, doc_id {kind}, similarity double")
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "doc_id"))), 1, k)
    return near.groupBy("query_id").agg(ordered.alias("t")).select("query_id", F.explode("t").alias("t")).select("query_id", "t.doc_id", (-F.col("t.s")).alias("similarity"))


def hashed_bags(docs: DataFrame, dim: int = 256, text: str = "text") -> DataFrame:
    """doc_id, vector: counts of hashed words in ``dim`` buckets, of length one."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    t = words.select("doc_id", F.pmod(F.hash("term"), F.lit(dim)).alias("b")).groupBy("doc_id", "b").agg(F.count("*").cast("double").alias("c"))
    m = t.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)) / F.col("norm"))
    return m.select("doc_id", F.transform(F.array("m"), dense)[0].alias("vector"))  # the map is made once for all buckets


def cloned_lines(docs: DataFrame, least_chars: int = 40, text: str = "text") -> DataFrame:
    """block_hash, n, n_docs, first_doc, first_line of normalised lines that occur more than once.

    A clone class is one row whatever its size; its members are not paired.
    """
    body = F.lower(F.trim(F.regexp_replace("txt", r"\s+", " ")))
    rows = lines(docs, text).withColumn("body", body).where(F.length("body") >= least_chars)
    place = F.min(F.struct("doc_id", "line"))
    return rows.groupBy(F.sha2("body", 256).alias("block_hash")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), place.alias("p")).where("n > 1").select("block_hash", "n", "n_docs", F.col("p.doc_id").alias("first_doc"), F.col("p.line").alias("first_line"))


def contained_items(docs: DataFrame, items: DataFrame, window: int = 8, text: str = "text") -> DataFrame:
    """item_id, n, first_doc: the items whose words stand one after another at any place of a document.

    Words are runs of letters and digits, case folded; items without words are in no document.  The first
    ``window`` words of an item (all, if it has fewer) are joined by hash with the windows of the documents,
    and the pairs that meet are compared word by word.  ``n`` counts pairs of a document row and an item text.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    joined = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    it = items.select("item_id", words.alias("w")).where(F.size("w") > 0).select("item_id", "w", F.least(F.size("w"), F.lit(window)).alias("len")).distinct()
    it = it.select("item_id", "len", F.xxhash64(F.slice("w", 1, F.col("len"))).alias("mark"), joined(F.col("w")).alias("passage"))
    lengths = sorted(r[0] for r in it.select("len").distinct().collect())  # at most ``window``
    d = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0)

    def marks(n: int) -> DataFrame:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return d.select("doc_id", F.explode(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, n)))).alias("mark")).withColumn("len", F.lit(n))

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, len int"
    met = docs.sparkSession.createDataFrame([], schema)
    for n in lengths:
        met = met.unionByName(marks(n))
    met = met.join(it, ["len", "mark"]).select(F.col("doc_id").alias("_doc"), "item_id", "passage").distinct()
    pairs = docs.select("doc_id", text).join(met, F.col("doc_id").eqNullSafe(F.col("_doc"))).where(F.contains(joined(words), F.col("passage")))
    return pairs.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def density_clusters(points: DataFrame, eps: float, min_points: int = 2, vid: str = "vec_id", vec: str = "embedding", group: str | None = None, block: int = 8192) -> DataFrame:
    """vec_id, cluster (-1: noise) by density; a point does not count as its own neighbour.

    Clusters are numbered by their least core point; a point that is none is in the first cluster next to
    it.  Points (ids are unique) are compared in pairs of blocks: once to count neighbours, once to join
    core points, where a pair of blocks gives a spanning forest and not its pairs.  The forests meet in one
    task.  With ``group``, groups are clustered apart, each as one matrix, for groups of bounded size.
    """
    if group is None:
        return _clusters_of_all(points, eps, min_points, vid, vec, block)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(vid)
        x = np.array(b[vec].tolist(), dtype=np.float64).reshape(len(b), -1)
        label, nxt = np.full(len(b), -2), 0

        def near(i: int) -> np.ndarray:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1)) <= eps
            d[i] = False
            return np.flatnonzero(d)

        for i in range(len(b)):
            if label[i] != -2:
                continue
            todo = list(near(i))
            if len(todo) < min_points:
                label[i] = -1
                continue
            label[i] = nxt
            while todo:
                j = todo.pop()
                if label[j] == -1:
                    label[j] = nxt
                if label[j] != -2:
                    continue
                label[j] = nxt
                more = near(j)
                if len(more) >= min_points:
                    todo.extend(more)
            nxt += 1
        return pd.DataFrame({vid: b[vid], "cluster": label})

    return points.select(vid, vec, group).groupBy(group).applyInPandas(run, f"{vid} long, cluster long")


def _clusters_of_all(points: DataFrame, eps: float, min_points: int, vid: str, vec: str, block: int) -> DataFrame:
    src = points.select(F.col(vid).cast("long").alias("id"), F.col(vec).alias("v"))
    blocks = max(8, -(-src.count() // block))

    def rows_near(b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Places in ``b`` of each point and of those within ``eps`` on the other side (the same, if there is one side)."""
        x = np.array(b["v"].tolist(), dtype=np.float64).reshape(len(b), -1)
        second = b["second"].to_numpy()
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        one_side = b["own"].iloc[0]
        norms = (x * x).sum(axis=1)
        slack = 1e-9 * (1 + norms.max())
        for mine, others in ((left, left),) if one_side else ((left, right), (right, left)):
            for at in range(0, len(mine), 512):
                tile = mine[at : at + 512]
                d = norms[tile, None] + norms[others] - 2 * (x[tile] @ x[others].T)
                near = d <= eps * eps
                for r, c in zip(*np.nonzero(np.abs(d - eps * eps) <= slack), strict=True):  # too close to call by this formula
                    near[r, c] = np.sqrt(((x[others[c]] - x[tile[r]]) ** 2).sum()) <= eps
                for r, i in enumerate(tile):
                    j = others[near[r]]
                    yield i, j[j != i]

    def count(b: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(b), dtype=np.int64)
        for i, j in rows_near(b):
            n[i] = len(j)
        return pd.DataFrame({"id": b["id"], "n": n})[n > 0]

    def join(b: pd.DataFrame) -> pd.DataFrame:
        ids, core = b["id"].to_numpy(), b["core"].to_numpy()
        root, edge = np.arange(len(b)), []
        for i, j in rows_near(b):
            j = j[core[j]]
            if not len(j):
                continue
            if not core[i]:
                edge += [(i, r) for r in np.unique(root[j])]
                continue
            met = np.unique(np.append(root[j], root[i]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
        edge = sorted({(i, root[r]) for i, r in edge})
        joined = np.flatnonzero(core & ((root != np.arange(len(b))) | b["own"].to_numpy()))
        a = np.concatenate([root[joined], np.array([r for _, r in edge], dtype=np.int64)])
        c = np.concatenate([joined, np.array([i for i, _ in edge], dtype=np.int64)])
        return pd.DataFrame({"a": ids[a], "b": ids[c], "core": core[c]})

    def finish(b: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in zip(*(b.loc[b["core"], c].tolist() for c in ("a", "b")), strict=True):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
        number = {r: n for n, r in enumerate(sorted({find(i) for i in list(root)}))}
        label = {i: number[find(i)] for i in list(root)}
        for i, j in zip(*(b.loc[~b["core"], c].tolist() for c in ("a", "b")), strict=True):
            label[j] = min(label.get(j, label[i]), label[i])
        return pd.DataFrame({"id": list(label), "cluster": list(label.values())})

    def dealt(p: DataFrame) -> DataFrame:
        p = p.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        task = F.least("k", "o") * blocks + F.greatest("k", "o")
        return p.withColumn("t", task).withColumn("second", F.col("k") > F.col("o")).withColumn("own", F.col("k") == F.col("o")).drop("k", "o").groupBy("t")

    counted = dealt(src).applyInPandas(count, "id long, n long").groupBy("id").agg((F.sum("n") >= min_points).alias("core"))
    flagged = src.join(counted, "id").withColumn("core", F.coalesce("core", F.lit(False)))  # others have no neighbour
    forest = dealt(flagged).applyInPandas(join, "a long, b long, core boolean").withColumn("all", F.lit(0))
    label = forest.groupBy("all").applyInPandas(finish, "id long, cluster long")
    return src.select("id").join(label, "id", "left").select(F.col("id").alias(vid), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def two_cycles(edges: DataFrame) -> DataFrame:
    """a < b for edges that stand in both directions."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def orphans(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Nodes that nothing points to."""
    return nodes.select(node).distinct().join(edges.select(F.col("dst").alias(node)).distinct(), node, "left_anti")


def _place_among(column: str, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below ``column``, by halving."""

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) <= bounds[mid], part(lo, mid)).otherwise(part(mid + 1, hi))

    return part(0, len(bounds))


def _opened(t: pa.Table) -> tuple[int, list[np.ndarray]]:
    """The number of sources of a block, and the numbers of the sources of each ``dst`` in the order of ``dst``."""
    t = t.take(pc.sort_indices(t["dst"].combine_chunks()))
    width = t["width"][0].as_py()
    kind = np.uint16 if width <= 1 << 16 else np.uint32
    sets = zip(t["n"].to_pylist(), t["set"].to_pylist(), strict=True)
    return width, [np.frombuffer(x, kind).astype(np.intp) if len(x) == n * kind().itemsize else np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), count=width)) for n, x in sets]


def _united(width: int, own: list[np.ndarray], other_width: int, other: list[np.ndarray]) -> np.ndarray:
    """For each source of a block, how many sources of another one are in the sets that it has a part in.

    Sets of more than 1 source in 256 are united as bitmaps, the others by marking their numbers.
    """
    much = np.array([len(x) * 256 > other_width for x in other])
    first = np.argsort(~much, kind="stable")
    dense, lists = int(much.sum()), [other[i] for i in first]
    bits = np.zeros((dense, -(-other_width // 64)), dtype=np.uint64)
    mark = np.zeros(other_width, dtype=bool)
    for i in range(dense):
        mark[:] = False
        mark[lists[i]] = True
        packed = np.packbits(mark)
        bits[i].view(np.uint8)[: len(packed)] = packed
    sizes = [len(own[i]) for i in first]
    key = np.concatenate([own[i] for i in first])
    key *= len(first)
    key += np.repeat(np.arange(len(first), dtype=np.int32), sizes)
    key.sort()
    ends = np.searchsorted(key, np.arange(width + 1) * len(first))
    middle = np.searchsorted(key, np.arange(width) * len(first) + dense)
    key %= len(first)
    of = key.astype(np.int32)
    del key
    n, last, wide = np.zeros(width, dtype=np.uint32), np.zeros(other_width, dtype=np.int64), bits.shape[1] >= 256
    one = np.zeros(bits.shape[1], dtype=np.uint64)
    for r in np.flatnonzero(np.diff(ends)).tolist():
        lo, mid, hi = ends[r], middle[r], ends[r + 1]
        if mid > lo:
            if wide:
                one[:] = bits[of[lo]]
                for j in of[lo + 1 : mid].tolist():
                    np.bitwise_or(one, bits[j], out=one)
            else:
                one = np.bitwise_or.reduce(bits[of[lo:mid]], axis=0)
            if mid == hi:
                n[r] = np.bitwise_count(one).sum(dtype=np.int64)
                continue
        each = np.concatenate([lists[j] for j in of[mid:hi].tolist()])
        if mid > lo:
            mark = np.unpackbits(one.view(np.uint8), count=other_width).view(bool)
        elif len(each) * 32 < other_width:  # of equal numbers the one that was written last counts
            order = np.arange(len(each))
            last[each] = order
            n[r] = np.count_nonzero(last[each] == order)
            continue
        else:
            mark[:] = False
        mark[each] = True
        n[r] = np.count_nonzero(mark)
    return n


def two_hop_reach(edges: DataFrame, share: int = 1 << 21) -> DataFrame:
    """src, reached: how many distinct ``src`` share a ``dst`` with each, itself among them.

    The distinct edges are written once and cut into blocks of about ``share`` edges, by ranges of ``src``.
    In a block the sources are numbered, and each ``dst`` has the set of its sources, as numbers or as a bitmap,
    whichever is shorter.  Every two blocks that share a ``dst`` meet once, with the sets of the shared ones, and
    each unites those of the other for its own sources, so that pairs of sources are never rows.  What a task
    holds depends on ``share`` and not on how far apart the keys are, how many sources a ``dst`` has or how
    many ``dst`` a source.  ``src`` are whole numbers; edges with a null are left out.
    """
    from ..streaming.store import shared_folder  # which reads other operators itself

    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    path = shared_folder(spark, "edges")
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").cast("long").alias("src"), "dst").distinct()
    e.write.parquet(path)
    e = spark.read.schema(e.schema).parquet(path)
    blocks = max(1, -(-e.count() // share))
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = sorted(set(e.agg(F.percentile_approx("src", cuts, max(1000, 20 * blocks))).first()[0])) if cuts else []
    e = e.select(_place_among("src", bounds).alias("block"), "src", "dst")
    dst = e.schema["dst"].dataType.simpleString()

    def numbered(t: pa.Table) -> pa.Table:
        names, src = np.unique(t["src"].to_numpy(), return_inverse=True)
        of = t["dst"].combine_chunks().dictionary_encode()
        src += of.indices.to_numpy() * np.int64(len(names))
        src.sort()
        start = np.searchsorted(src, np.arange(len(of.dictionary) + 1) * len(names))
        src %= len(names)
        short = np.uint16 if len(names) <= 1 << 16 else np.uint32
        sets, src = [], src.astype(short)
        for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            x = src[lo:hi]
            if x.nbytes > -(-len(names) // 8):
                mark = np.zeros(len(names), dtype=bool)
                mark[x] = True
                x = np.packbits(mark)
            sets.append(x.tobytes())
        same = lambda v: pa.repeat(pa.scalar(v, pa.int32()), len(sets))
        return pa.table({"block": same(t["block"][0].as_py()), "dst": of.dictionary, "width": same(len(names)), "n": pa.array(np.diff(start), pa.int32()), "set": pa.array(sets, pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        a, *b = sorted(pc.unique(t["block"]).to_pylist())
        x = _opened(t.filter(pc.equal(t["block"], a)))
        if not b:
            found = [(a, _united(*x, *x))]
        else:
            y = _opened(t.filter(pc.equal(t["block"], b[0])))
            found = [(a, _united(*x, *y)), (b[0], _united(*y, *x))]
        return pa.table({"block": pa.array([k for k, _ in found], pa.int32()), "n": pa.array([n.tobytes() for _, n in found], pa.binary())})

    def total(t: pa.Table, names: pa.Table) -> pa.Table:
        n = np.zeros(len(names), dtype=np.int64)
        for x in t["n"]:
            n += np.frombuffer(x.as_py(), np.uint32)
        return pa.table({"src": np.sort(names["src"].to_numpy()), "reached": n})

    sets = e.repartition(4 * blocks, "block").groupBy("block").applyInArrow(numbered, f"block int, dst {dst}, width int, n int, set binary")
    met = sets.withColumn("others", F.collect_set("block").over(Window.partitionBy("dst")))
    pairs = met.withColumn("other", F.explode("others")).select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), *sets.columns)
    counts = pairs.repartition(min(blocks * (blocks + 1) // 2, 64 * blocks), "lo", "hi").groupBy("lo", "hi").applyInArrow(meet, "block int, n binary")
    names = e.select("block", "src").distinct()
    return counts.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(total, "src long, reached long").withColumn("src", F.col("src").cast(kind))


def hubs(edges: DataFrame, least: int = 5) -> DataFrame:
    """node, degree of nodes with ``least`` distinct neighbours or more."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
    return both.groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") >= least)


def resolve_imports(imports: DataFrame, files: DataFrame, specifier: str = "specifier", path: str = "path") -> DataFrame:
    """Each import with ``resolved``, the first of its candidate paths that exists (case folded last)."""
    ends = ["", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts"]
    c = imports.select("*", F.posexplode(F.array(*[F.concat(F.col(specifier), F.lit(e)) for e in ends])).alias("rank", "candidate"))
    f = files.select(F.col(path).alias("resolved"), F.lower(path).alias("_low")).distinct()
    hit = c.join(f, F.lower("candidate") == F.col("_low")).withColumn("rank", F.col("rank") + F.when(F.col("candidate") == F.col("resolved"), 0).otherwise(100))
    best = hit.groupBy(*imports.columns).agg(F.min_by("resolved", "rank").alias("resolved"))
    return imports.join(best, imports.columns, "left")
