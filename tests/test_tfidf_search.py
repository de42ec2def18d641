"""TF-IDF search against plain loops, and the rows that its plan makes."""

import math
import random
import re
from collections import Counter, defaultdict

from stratalens.operators import similarity

SCHEMA = "doc_id long, text string"


def plain(rows, queries, k=5, threshold=0.3):
    tf = defaultdict(Counter)
    for i, text in rows:
        tf[i].update(re.findall("[a-z]{3,}", (text or "").lower()))
    df = Counter(w for c in tf.values() for w in c)
    weight = {i: {w: m * math.log(len(rows) / df[w]) for w, m in c.items() if df[w] < len(rows)} for i, c in tf.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in weight.items()}
    out = set()
    for q in set(queries) & set(tf):
        found = []
        for i in tf:
            common = weight[q].keys() & weight[i].keys()
            if i is not None and i != q and common:
                s = sum(weight[q][w] * weight[i][w] for w in common) / (norm[q] * norm[i])
                if s >= threshold:
                    found.append((-round(s, 6), i))
        out |= {(q, i, -s) for s, i in sorted(found)[:k]}
    return out


def made_rows(plan):
    """Rows that come out of the nodes of a plan."""
    own = [plan.metrics().apply("numOutputRows").value()] if plan.metrics().contains("numOutputRows") else []
    return own + [n for i in range(plan.children().size()) for n in made_rows(plan.children().apply(i))]


def test_common_terms_are_no_rows_for_pairs(spark):
    words = [f"w{a}{b}x" for a in "abcdefgh" for b in "abcde"]
    rows = [(i, " ".join(w for j, w in enumerate(f"term{w[1:3]}" for w in words) if j != i % 40)) for i in range(60)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = similarity.tfidf_search(spark.createDataFrame(rows, SCHEMA), list(range(60)))
        got = {tuple(r) for r in df.collect()}
        most = max(made_rows(df._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == plain(rows, range(60)) and len(got) > 60
    assert most < 60 * 60  # the join by terms made a row for each of 60 * 59 * 38 products


def test_search_equals_plain_loops(spark):
    r = random.Random(3)
    names = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    rows = []
    for i in range(150):
        base = rows[r.randrange(len(rows))][1].split() if rows and r.random() < 0.5 else []
        text = base[: r.randint(0, 40)] + [names[min(int(r.expovariate(0.02)), 399)] for _ in range(r.randint(1, 40))]
        rows.append((i - 20, r.choice([" ", "-", "é", " 12 "]).join(text) if i % 10 else " ".join(text).upper()))
    rows += [(5, rows[30][1]), (5, "Kelvin Kelvin İstanbul Über"), (6, None), (7, ""), (8, "ab c"), (None, rows[40][1]), (900, None), (901, rows[40][1])]
    queries = [*range(-20, 120, 3), 5, 901, 7, 900, 4000]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows, queries)
    assert len(want) > 40
    for block, pairs in ((1 << 22, 1 << 18), (300, 90), (3000, 1)):
        assert {tuple(x) for x in similarity.tfidf_search(docs, queries, block=block, pairs=pairs).collect()} == want
    assert sorted(tuple(x) for x in similarity.tfidf_search(docs, queries + queries, share=500).collect()) == sorted(want)  # in rounds
    assert {tuple(x) for x in similarity.tfidf_search(docs, queries, k=2, threshold=0.0).collect()} == plain(rows, queries, 2, 0.0)


def test_search_without_queries_or_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], SCHEMA)
    assert similarity.tfidf_search(docs, []).collect() == [] and similarity.tfidf_search(docs, [9]).collect() == []
    assert similarity.tfidf_search(spark.createDataFrame([(1, None), (2, "")], SCHEMA), [1, 2]).collect() == []
    assert similarity.tfidf_search(docs.where("doc_id > 5"), [1]).collect() == []
