import hashlib
import random

import numpy as np
import pytest

from stratalens.llm import queries, suffix_dedup as S

from .helpers import DATA, ODD, SCHEMA, rows


def brute(docs, span=100):
    seen, out = set(), []
    for d, t in docs:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - span + 1):
            w = data[s : s + span]
            if w in seen:
                gone[s : s + span] = b"\1" * span
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append({"doc_id": d, "n_bytes": len(data), "n_removed": sum(gone), "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return out


def crowd(seed=5):
    """Copies, near copies, shared passages at odd places, runs of one letter, repeats inside a text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base, docs = prose(30), prose(150), []
    for i in range(120):
        k = rng.randrange(8)
        t = prose(rng.randint(1, 120))
        if k == 0:
            t = base
        elif k == 1:
            w = base.split()
            w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif k in (2, 3):
            cut = rng.randrange(0, 60)
            t = prose(9) + passage[cut:] + prose(9)
        elif k == 4:
            t = "z" * rng.randint(90, 400)
        elif k == 5:
            t = t + t
        docs.append((1000 - i * 3, t))
    return sorted(docs)


def test_op10(spark):
    docs = sorted((r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    assert rows(queries.op10_suffix_dedup(spark, DATA), "doc_id") == brute(docs)


@pytest.mark.parametrize(("hold", "shard", "hot"), [(1_500_000, 1_000_000, 2048), (300, 2_000, 2048), (1_500_000, 1_000_000, 2), (300, 2_000, 5)])
def test_small_blocks_cut_keys_and_hot_grams(spark, hold, shard, hot):
    docs = crowd()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = {r["doc_id"]: r["n_removed"] for r in brute(docs)}
    gone = {}
    for r in S.repeated_ranges(S.with_keys(df), hold, shard, hot).collect():
        gone.setdefault(r.did, []).append((r.lo, r.hi + S.SPAN))
    assert {d: sum(j - i for i, j in S.unite(gone.get(d, []))) for d in want} == want


def test_odd_rows(spark):
    docs = sorted(((r[0], r[1]) for r in ODD), key=lambda r: r[0])
    df = spark.createDataFrame(ODD, SCHEMA).withColumnRenamed("source", "tie").withColumnRenamed("lang", "cut")
    assert rows(S.remove_repeats(df).drop("kept"), "doc_id") == brute(docs)
    assert S.remove_repeats(df.limit(0)).count() == 0
    extra = spark.createDataFrame([(None, "q" * 150, "", "", 1), (4, "q" * 150, "", "", 1), (4, "q" * 150, "", "", 1), (4, None, "", "", 1)], SCHEMA)
    out = S.remove_repeats(extra).collect()
    assert sorted((r.doc_id is not None, r.n_bytes, r.n_removed) for r in out) == [(False, 150, 149), (True, 0, 0), (True, 150, 150), (True, 150, 150)]


def test_rows_that_share_an_id_are_different_documents(spark):
    """Also where a short checksum of their texts is equal: crc32 mod 2**15 is, for the first two."""
    import zlib

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(22))
    by_sum, pair = {}, None
    while pair is None:
        t = f"{word()} {word()} {passage} {word()} {word()}"
        other = by_sum.setdefault(zlib.crc32(t.encode()) % 2**15, t)
        pair = (other, t) if other != t else None
    docs = [(5, pair[0]), (5, pair[1]), (5, f"x {passage}"), (2, passage), (9, None), (9, passage + passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    order = [(r[0], r[1]) for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").orderBy("doc_id", "h").collect()]
    key = lambda r: (r["doc_id"], r["n_bytes"], r["kept_sha256"])
    assert sorted((r.asDict() for r in S.remove_repeats(df).drop("kept").collect()), key=key) == sorted(brute(order), key=key)


def test_text_over_a_piece_long(spark):
    rng = np.random.default_rng(4)
    long = rng.integers(97, 123, 1_300_000).astype(np.uint8).tobytes().decode()
    docs = [(1, long), (2, long[1_048_000:1_049_200] + "-"), (3, "+" + long[:150])]
    out = {r.doc_id: r.n_removed for r in S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 1200, 3: 150}


def test_pieces_of_long_texts_have_the_anchors_of_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 20_000).astype(np.uint8).tobytes()
    whole = S.anchors(data)
    monkeypatch.setattr(S, "_PIECE", 1500)
    assert all((a == b).all() for a, b in zip(whole, S.anchors(data)))


@pytest.mark.parametrize("kind", ["random", "periodic", "one"])
def test_suffix_array_and_kasai(kind):
    rng = np.random.default_rng(2)
    t = {"random": rng.integers(0, 4, 700), "periodic": np.arange(500) % 7, "one": np.full(300, 5)}[kind]
    sa, rank = S.suffix_array(t, len(t))
    text = bytes(t.astype(np.uint8))
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: text[i:])
    for cap in (5, 10_000):
        lcp = S.common_prefixes(t, sa, cap, lanes=7)
        for i in range(1, len(sa)):
            a, b = text[sa[i - 1] :], text[sa[i] :]
            n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert lcp[i] == min(n, cap)
    assert len(S.suffix_array(t[:0], 5)[0]) == 0
