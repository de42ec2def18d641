"""Two-hop reach against plain loops, for keys and degrees of several kinds, and the rows that its plan makes."""

import random

import numpy as np
from pyspark.sql import functions as F

from stratalens.operators import similarity


def plain(e):
    of, want = {}, {}
    for a, b in e:
        of.setdefault(b, set()).add(a)
    for a, b in e:
        want.setdefault(a, set()).update(of[b])
    return {a: len(x) for a, x in want.items()}


def made_rows(plan):
    """Rows that come out of the nodes of a plan."""
    own = [plan.metrics().apply("numOutputRows").value()] if plan.metrics().contains("numOutputRows") else []
    return own + [n for i in range(plan.children().size()) for n in made_rows(plan.children().apply(i))]


def test_sources_far_apart_are_no_rows_for_pairs(spark):
    e = [(k * 40_000, 1) for k in range(40)] + [(k * 10**15, k % 3) for k in range(-20, 20)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = similarity.two_hop_reach(spark.createDataFrame(e, "src long, dst long"))
        got = {r.src: r.reached for r in df.collect()}
        most = max(made_rows(df._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == plain(e)
    assert most < 10 * len(e)  # a bitmap went to each pair of ranges of sources that share a dst


def test_reach_by_blocks_of_edges_equals_loops(spark):
    r = random.Random(4)
    cases = [
        ([(5, k) for k in range(500)] + [(6, 3), (7, 499)], 100),  # a source with most edges
        ([(k, k % 2) for k in range(600)] + [(k, 2 + k) for k in range(600)], 400),  # a dst with half of the sources
        ([(r.randrange(60), r.randrange(300)) for _ in range(900)], 250),
        ([], 100),
    ]
    for e, share in cases:
        df = spark.createDataFrame(e, "src long, dst long")
        assert {x.src: x.reached for x in similarity.two_hop_reach(df, share).collect()} == plain(e)
    e = [(a, f"k{b}") for a, b in cases[2][0]]
    for kind in ("int", "decimal(20,0)", "double"):
        got = similarity.two_hop_reach(spark.createDataFrame(e, "src int, dst string").withColumn("src", F.col("src").cast(kind)))
        assert {int(x.src): x.reached for x in got.collect()} == plain(e) and got.schema["src"].dataType.simpleString() == kind


def test_sets_of_any_density_are_united():
    r = np.random.default_rng(1)
    for width, other_width, n in ((50, 3000, 40), (3000, 50, 40), (700, 20000, 60), (400, 400, 30), (5, 1, 3), (300, 70000, 50)):
        some = lambda w, most: np.sort(r.choice(w, r.integers(1, max(1, most) + 1), replace=False))
        own = [some(width, min(width, 20)) for _ in range(n)]
        other = [some(other_width, int(other_width * r.choice([0.001, 0.003, 0.01, 0.3]))) for _ in range(n)]
        want = [len({x for a, b in zip(own, other, strict=True) if i in a for x in b.tolist()}) for i in range(width)]
        assert similarity._united(width, own, other_width, other).tolist() == want
