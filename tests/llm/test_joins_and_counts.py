import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import components, parity_join, queries, viterbi, winnow

from .helpers import DATA, ODD, SCHEMA, lower, rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- token counts


def library_model(v):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *v.pieces] if v.byte_fallback else [("<unk>", 0.0), *v.pieces]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=v.byte_fallback))
    if v.add_prefix:
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return t


def test_op2_equals_the_library(spark):
    v = viterbi.load_unigrams(queries.vocabulary("piece_bpe_32k.model"))
    assert v.by_chunk
    model = library_model(v)
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    out = rows(queries.op2_token_counts(spark, DATA), "doc_id")
    assert len(out) == len(docs)
    for r in out:
        assert r["n_tokens"] == len(model.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
    c = viterbi.Counter(v)
    for t in ["a  b", " lead", "trail ", "   ", "tabs\tand\nlines", "😀漢字 ¿ñ", "x" * 500, "日本語のテキスト", "mid   dle     runs"]:
        assert c.count(t)[0] == len(model.encode(t, add_special_tokens=False).ids), t
    df = spark.createDataFrame([*ODD, (None, "null id", None, None, None)], SCHEMA)
    odd = {r.doc_id: r.n_tokens for r in viterbi.count_tokens(df, v).collect()}
    assert odd[5] == 0 and odd[3] == 0 and len(odd) == len(ODD) + 1 and viterbi.count_tokens(df.limit(0), v).count() == 0


@pytest.mark.parametrize("fallback", [False, True])
def test_ties_and_unknowns_follow_the_library(fallback):
    """Few letters and equal scores make ties; 'd' and 'é' are no pieces of their own."""
    rng = random.Random(4)
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.0, "c": -2.5}
    while len(pieces) < 60:
        pieces["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 5)))] = -float(rng.randint(2, 9)) / 2
    v = viterbi.Unigrams(tuple(pieces.items()), byte_fallback=fallback, add_prefix=False)
    model, c = library_model(v), viterbi.Counter(v)
    for _ in range(600):
        t = "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 25)))
        assert c.count(t)[0] == len(model.encode(t).ids), t


def test_viterbi_score_is_the_best_of_all_segmentations():
    pieces = {"a": -1.0, "ab": -1.5, "b": -3.0, "abc": -9.0, "c": -0.5, "bc": -2.0}
    c = viterbi.Counter(viterbi.Unigrams(tuple(pieces.items()), add_prefix=False))

    def best(t):
        return 0.0 if not t else max(pieces[t[:k]] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in pieces)

    for t in ("a", "abc", "aabcc", "bbabcabc"):
        assert c.count(t)[1] == best(t)


# ---- decontamination


def brute_contamination(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append({"doc_id": d, "n_words": len(w), "n_hit": len(hit), "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "contaminated": bool(hit)})
    return sorted(out, key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["n_words"]))


def test_op6(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    out = rows(queries.op6_decontamination(spark, DATA), "doc_id")
    assert out == brute_contamination(docs, items) and any(r["contaminated"] for r in out)


@pytest.mark.parametrize("broadcast", [0, 10_000])
def test_op6_short_items_ties_and_odd_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", broadcast)
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "a", "É", "ten", "x1", "漢", "of"])
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(1, "Seven"), (2, "x1 the of, a"), (3, prose(14)), (33, None), (4, ""), (None, prose(12)), (5, "a " * 40), (6, prose(9)), (10, prose(10)), (10, prose(10))]
    docs = [(i, prose(rng.randint(0, 60)) + rng.choice(["", " seven!", f"; {items[2][1]} " * 2, items[5][1].upper().replace("É", "é"), " a" * 15])) for i in range(60)]
    docs += [(100, None), (101, ""), (None, items[2][1]), (3, docs[3][1]), (5, "other text seven")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as w", "2 as span", "3 as th").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as mark")
    out = sorted((r.asDict() for r in winnow.decontaminate(d, b).collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["n_words"]))
    assert out == brute_contamination(docs, items)
    assert winnow.decontaminate(d, b.limit(0)).where("contaminated").count() == 0
    assert winnow.decontaminate(d.limit(0), b).count() == 0


# ---- n-gram join


def shingles(t):
    w = BLANK_WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    label = {d: d for d, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, u in sets[:i]:
            if s and u and 100 * len(s & u) >= 80 * len(s | u):
                a, b = find(d), find(e)
                label[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for d, s in sets)


def family(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    prose = lambda k: [word() for _ in range(k)]
    passage, docs = prose(40), []
    bases = [prose(k) for k in (1, 4, 5, 6, 9, 12, 30, 60, 120, 300)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = prose(rng.randrange(2))
            w = w or prose(1)
        if rng.random() < 0.2:
            w = prose(rng.randint(2, 30)) + passage + prose(rng.randint(2, 30))
        docs.append((i * 7 % 1009, rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("settings", [parity_join.JoinSettings(), parity_join.JoinSettings(frequent_from=4, max_frequent=300)])
def test_no_link_is_lost(spark, seed, settings):
    docs = family(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, parity_join.near_duplicates(df, settings).collect())) == brute_components(docs)


def test_published_blocks_of_all_similar_sets_meet():
    """The pigeonhole bound by itself, at and around the threshold, with and without frequent tokens."""
    rng, s = np.random.default_rng(3), parity_join.JoinSettings()
    for n in [1, 2, 4, 5, 6, 8, 9, 10, 15, 16, 17, 40, 63, 64, 100, 127, 128, 500]:
        for _ in range(25):
            u = rng.integers(0, 2**63, n + n // 4 + 2).astype(np.uint64)
            a = np.unique(u[:n])
            take = int(rng.integers(max(1, int(0.75 * n)), n + 1))
            b = np.unique(np.concatenate([u[:take], u[n : n + int(rng.integers(0, n // 4 + 2))]]))
            frequent = np.sort(rng.choice(u, int(rng.choice([0, n // 2, len(u)])), replace=False))
            if s.linked(len(a), len(b), len(np.intersect1d(a, b))):
                assert len(np.intersect1d(parity_join.signatures(a, frequent, s), parity_join.signatures(b, frequent, s)))


def near_misses(n, changes, seed=1, words=60):
    """Copies of one text with some words of their own: pairs share most blocks and are not linked."""
    rng, base, out = random.Random(seed), [f"w{i}" for i in range(words)], []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(words), changes):
            w[k] = f"x{rng.random()}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("changes", [1, 2])
def test_pairs_of_near_misses_grow_with_their_number(spark, changes):
    """Rows of pairs, before and after the comparison of sketches, follow the copies and not their pairs."""
    s, seen = parity_join.JoinSettings(), {}
    for n in (250, 1000):
        docs = near_misses(n, changes)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        surveyed = parity_join.survey(df, s=s).cache()
        frequent = parity_join.frequent_tokens(surveyed, s)
        found = parity_join.candidates(df, frequent, s).cache()
        stars = found.where("kind = 1").select("a", "b").distinct()
        classes = surveyed.where("kind = 0").selectExpr("cid", "n_shingles as n", "sketch")
        members = found.where("kind = 2").selectExpr("a as cid", "na as n", "b as bucket", "a as component").distinct()
        sizes = members.groupBy("bucket").agg(F.count("*").alias("m"))
        crossed = parity_join.cross_pairs(members.join(sizes, "bucket").join(classes.select("cid", "sketch"), "cid"), True, s)
        seen[n] = (stars.count(), crossed.count())
    assert seen[1000][0] <= 6 * seen[250][0] and seen[1000][0] < 20 * 1000 and seen[1000][1] <= 1000
    sets = {d: frozenset(parity_join.tokens_of(t.encode()).tolist()) for d, t in docs}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = {d: d for d in sets}
    for a, b in sorted(linked):
        x, y = sorted((label[a], label[b]))
        label = {d: x if v == y else v for d, v in label.items()} if x != y else label
    assert {r.doc_id: r.component_id for r in parity_join.near_duplicates(df).collect()} == label


def test_tiles_of_a_cut_bucket_hold_every_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: int(rng.integers(60, 100))], rng.integers(0, 2**63, int(rng.integers(0, 20))).astype(np.uint64)])) for _ in range(60)]
    s = parity_join.JoinSettings(tile=7)
    near = lambda a, b: 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and parity_join.hamming(parity_join.bit_sketch(a), parity_join.bit_sketch(b)) <= s.differences(len(a), len(b))
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if near(sets[i], sets[j])}
    rows = [(1, i, len(u), i, bytearray(parity_join.bit_sketch(u).tobytes()), 60) for i, u in enumerate(sets)]
    df = spark.createDataFrame(rows, "bucket long, cid long, n long, component long, sketch binary, m long")
    assert {(r.a, r.b) for r in parity_join.cross_pairs(df, False, s).collect()} == want and want
    forest = [(r.a, r.b) for r in parity_join.cross_pairs(df, True, s).collect()]
    groups = lambda pairs: {frozenset(c) for c in _components(60, pairs)}
    assert set(forest) <= want and groups(forest) == groups(want)


def _components(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [x if v == y else v for v in label]
    return [[i for i in range(n) if label[i] == k] for k in set(label)]


def test_bit_sketches_bound_the_symmetric_difference():
    rng = np.random.default_rng(7)
    for n in (1, 5, 100, 700, 3000):
        u = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        for k in (0, 1, n // 3, n):
            a, b = u[:n], u[k : n + k]
            assert parity_join.hamming(parity_join.bit_sketch(a), parity_join.bit_sketch(b)) <= len(np.setxor1d(a, b))
    assert parity_join.hamming(parity_join.bit_sketch(u[:10]), parity_join.bit_sketch(u[:10])) == 0


def test_op9(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op9_ngram_join(spark, DATA).collect())) == brute_components(docs)


def test_op9_odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumnRenamed("lang", "cid").withColumnRenamed("source", "component")
    assert sorted(map(tuple, parity_join.near_duplicates(df).collect())) == brute_components([(r[0], r[1]) for r in ODD])
    assert parity_join.near_duplicates(df.limit(0)).count() == 0
    again = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (4, "q r s t u v"), (9, "q r s t u v"), (None, "n m"), (None, "a b c d e f")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id) for r in parity_join.near_duplicates(again).collect()), key=str)
    assert out == [(4, 4), (4, 4), (4, 4), (9, 4), (None, 4), (None, None)]


def test_components_of_a_chain_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(5, 5), (100, 101), (None, 3)], "a long, b long")
    got = dict(map(tuple, components.connected_components(chain, "a", "b").collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.connected_components(chain.limit(0), "a", "b").count() == 0


def test_rows_without_id_link_and_bridge(spark):
    from stratalens.llm.parity_join import near_duplicates

    words = [f"w{i}" for i in range(120)]
    change = lambda *at: " ".join(f"y{i}" if i in at else w for i, w in enumerate(words))
    far = lambda n: " ".join(f"{n}v{i}" for i in range(60))
    a, bridge, c = change(), change(*range(7)), change(*range(14))  # a and c are linked by the bridge only
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    near = lambda rows: {(r.doc_id, r.n_shingles): r.component_id for r in near_duplicates(df(rows)).collect()}
    with_id, without = (near([(1, a), (i, bridge), (3, c), (4, far(4)), (None, far(5))]) for i in (2, None))
    value = lambda got, i: {v for (k, _), v in got.items() if k == i}
    assert value(with_id, 2) == value(with_id, 1) == {1}
    assert value(with_id, 3) == value(without, 3) == {1} and value(near([(1, a), (3, c)]), 3) == {3}
    assert value(without, None) == {1, None}  # the bridge, and the row that is like no other
    assert value(without, 4) == {4}
