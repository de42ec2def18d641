"""Operators 11 to 13 against brute force, the library and DuckDB."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratalens.llm import divergence, importance, merge_automaton
from stratalens.llm.queries import QUERIES, table, vocabulary

from ..oracle import connect, same
from .helpers import DATA, ODD, SCHEMA, lower

BPE = "byte_bpe_50k.json"


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute_resample(docs, target, min_words=20, percent=25):
    crc = lambda f: zlib.crc32(f.encode()) % 10_000
    own, aim = (Counter(crc(f) for t in texts for f in features(t)) for texts in ([t for _, t in docs], target))
    s_all, t_all = sum(own.values()) + 10_000, sum(aim.values()) + 10_000
    out = []
    for doc, text in docs:
        f = features(text)
        gain = [math.floor(1000 * math.log((aim[k] + 1) * s_all / ((own[k] + 1) * t_all))) for k in map(crc, f)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 2 * min_words - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def as_tuples(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


def test_resampling_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()]
    target = [r["text"] for r in table(spark, DATA, "benchmark").collect()]
    got = as_tuples(QUERIES["op11_importance_resampling"](spark, DATA))
    assert got == brute_resample(docs, target) and any(r[4] for r in got)


def test_resampling_of_odd_ties_repeats_and_clashing_columns(spark):
    rows_ = [(d, t) for d, t, *_ in ODD] + [(None, "a b " * 30), (None, None), (1, "a b " * 30), (1, "a b " * 30)]
    docs = spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in rows_], "doc_id long, text string, bucket int, place string, part int, base int")
    target = spark.createDataFrame([("a b c",), (None,)], "text string")
    assert as_tuples(importance.resample(docs, target)) == brute_resample(rows_, ["a b c", None])
    assert as_tuples(importance.resample(docs, target.limit(0), percent=100, min_words=1)) == brute_resample(rows_, [], 1, 100)
    assert importance.resample(docs.limit(0), target).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 700, 37])
def test_streams_of_long_texts_and_long_words(monkeypatch, block):
    monkeypatch.setattr(importance, "_BLOCK", block)
    rng = random.Random(block)
    texts = [None, "", "é" * 100 + " a " + "b" * 200, "a" * 3000 + " " + " ".join("bcdef"[i] * (62 + i) for i in range(5)), "漢字 漢 ab", "\x00\x7f"]
    texts += ["".join(rng.choice("abAZ09 \n-é漢\x7f@[`{/:") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    if block == 1 << 20:
        texts.append("wörd and " * 200_000 + "z" * 1_500_000 + " end")
    got = []
    for lo, hi, begins, stream in importance.streams([None if t is None else t.encode() for t in texts], 10_000):
        assert hi - lo == len(begins)
        got += [sorted(s.tolist()) for s in np.split(stream, begins[1:])]
    assert got == [sorted(zlib.crc32(f.encode()) % 10_000 for f in features(t)) for t in texts]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(BPE))
    t.no_truncation()
    t.no_padding()
    return t


ODD_TEXTS = [
    "", " ", "x" * 5000, "a" * 17, "aaaa aaa aa", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "日本語テキスト 漢字", "  \n\n\t x  y", "é ß ſ K ÅÅ", "🙂🙃" * 50, "ha" * 1000, "\x00\x1c a\x1fb",
    "it's we'LL 's", "  x́", "ab" * 700_000,
]


def test_automaton_equals_the_library_on_odd_texts(library):
    e, rng = merge_automaton.AutomatonEncoder(vocabulary(BPE)), random.Random(1)
    texts = ODD_TEXTS + ["".join(rng.choice("aab  \nthe'ns0123éß漢🙂\x00.,!-=_*") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.randint(1, 0x2FFF)) for _ in range(40)) for _ in range(200)]
    for t in texts:
        ids = np.frombuffer(e.encode([t])[0], dtype="<u4").tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids, t[:80]
        assert e.decode(ids).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False) == t


def merge_by_hand(word, merges):
    """Each merge in order of priority, everywhere from the left."""
    ids = list(word)
    for u, v, w in merges:
        out, k = [], 0
        while k < len(ids):
            if ids[k : k + 2] == [u, v]:
                out.append(w)
                k += 2
            else:
                out.append(ids[k])
                k += 1
        ids = out
    return ids


@pytest.mark.parametrize("seed", range(12))
def test_automaton_of_random_merges(monkeypatch, seed):
    monkeypatch.setattr(merge_automaton, "_MAX_STATES", 9 if seed % 2 else 120_000)  # the table is emptied within words
    monkeypatch.setattr(merge_automaton, "_FEW", seed)
    rng = random.Random(seed)
    arcs, merges, pairs = {b: bytes([b]) for b in range(256)}, [], set()
    pool = [97, 98, 99]
    while len(merges) < 25:
        u, v = rng.choice(pool), rng.choice(pool)
        label = arcs[u] + arcs[v]
        if (u, v) in pairs or label in arcs.values():
            continue
        pairs.add((u, v))
        w = 256 + len(merges)
        arcs[w] = label
        merges.append((u, v, w))
        pool.append(w)
    a = merge_automaton.MergeAutomaton(arcs, merges)
    for _ in range(400):
        word = bytes(rng.choice(b"aaabbcd") for _ in range(rng.randint(0, 40)))
        assert a.encode(word) == merge_by_hand(word, merges)


def test_merges_that_make_a_token_twice_are_refused():
    with pytest.raises(ValueError):
        merge_automaton.MergeAutomaton({97: b"a", 98: b"b", 300: b"ab"}, [(97, 98, 300), (97, 98, 300)])


def test_bpe_query_equals_the_library(spark, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op12_bpe_automaton"](spark, DATA).collect()}
    docs = table(spark, DATA, "documents").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_encode_then_decode_odd_rows(spark, library):
    docs = spark.createDataFrame([(d, t, l, s, n) for d, t, l, s, n in ODD] + [(None, "<|endoftext|> x", None, None, None)], SCHEMA).withColumn("ids", docs_column())
    encoded = merge_automaton.encode_documents(docs, vocabulary(BPE))
    assert sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=repr) == sorted(((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()), key=repr)
    back = merge_automaton.decode_documents(encoded, vocabulary(BPE))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=repr)
    odd_ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in merge_automaton.decode_documents(odd_ids, vocabulary(BPE)).collect()] == ["", ""]
    assert merge_automaton.round_trip(docs.limit(0), vocabulary(BPE)).collect() == []


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("a column of the same name")


def brute_audit(docs, min_docs=3, top=200):
    text, df = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
        text[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    out = []
    for lang, source in text:
        kept = [k for k, n in df[lang].items() if n >= min_docs]
        share = lambda c, lang=lang, kept=kept: {k: 1 + 10**9 * (c[k] + 1) // (sum(c[x] for x in kept) + len(kept)) for k in kept}
        whole = sum((c for (la, _), c in text.items() if la == lang), Counter())
        p, q = share(text[lang, source]), share(whole)
        pair = []
        for (la, other), c in text.items():
            if la == lang and other != source:
                o = share(c)
                pair.append((other, sum((p[k] - o[k]) ** 2 // o[k] for k in kept)))
        term = [(k, (p[k] - q[k]) ** 2 // q[k]) for k in kept if text[lang, source][k] and p[k] > q[k]]
        for part, items in (("pair", pair), ("term", term)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                if part == "pair" or rank <= top:
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


def audited(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_audit_equals_its_sql(spark):
    from stratalens.llm.divergence import ORACLE

    assert same(QUERIES["op13_source_divergence"](spark, DATA), connect(DATA).sql(ORACLE)) == ""


@pytest.mark.parametrize(("block", "sources", "top"), [(512, 128, 200), (3, 2, 4), (1, 1, 1)])
def test_audit_of_odd_rows_in_small_tiles(spark, monkeypatch, block, sources, top):
    monkeypatch.setattr(divergence, "_HELD", 20)
    monkeypatch.setattr(divergence, "_AT_ONCE", 7)
    monkeypatch.setattr(divergence, "_SENT", 1 if block == 3 else 20_000)
    rng = random.Random(block)
    docs = [(t, lang, s) for _, t, lang, s, _ in ODD] + [(None, "en", "empty"), ("", None, "e"), ("ties ties", "fr", "a"), ("ties", "fr", "b"), ("ties", "fr", "b")]
    docs += [(" ".join(rng.choice(["alpha", "Beta", "gämma", "δ", "x1y", "the", "THE", "zz-zz"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s", "t", "ü", "z", None, "w"])) for _ in range(120)]
    df = spark.createDataFrame([(i, *d, 1, 2) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, n int, kind int")
    assert audited(divergence.audit(df, top=top, block=block, sources=sources)) == brute_audit(docs, top=top)
    assert divergence.audit(df.limit(0)).collect() == []


def test_audit_of_a_very_long_text(spark):
    docs = [("mot " * 400_000 + "x" * 1_200_000, "en", "a"), ("mot other", "en", "b"), ("mot other", "en", "b"), ("other", "en", "a")]
    assert audited(divergence.audit(spark.createDataFrame(docs, "text string, lang string, source string"))) == brute_audit(docs)


def test_shares_of_huge_counts_are_exact():
    count, total = np.array([0, 5, 3_999_999_999_999, 8_999_999_999_999_998]), 9_000_000_000_000_000 - 1
    assert divergence.share(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in count]




def test_divergence_hands_on_no_more_rows_for_more_tasks(spark, monkeypatch):
    words = ["".join(chr(97 + (k // 26**i) % 26) for i in range(3)) for k in range(120)]
    rows = [(k, " ".join(words[k % 5 :: 2]), "en", "abc"[k % 3]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    handed, table = [], divergence.Scratch.table
    monkeypatch.setattr(divergence.Scratch, "table", lambda self, df, name, *a: (out := table(self, df, name, *a), handed.append(out.count()) if name == "tiles" else None)[0])
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {tuple(r) for r in divergence.audit(docs, top=2, block=4).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {tuple(r) for r in divergence.audit(docs, top=2, block=4).collect()}
    assert handed[0] <= 4 * (3 * 2 + 3 * 2)  # 30 blocks in 4 runs, each with 6 pairs and 2 terms of 3 groups at most
