import pytest

import corpus_pipeline as P
from stratalens.llm import queries

from .helpers import DATA, ODD, SCHEMA
from .test_joins_and_counts import WORD, brute_components, brute_contamination
from .test_tokens_packing_files import check_packing, reference_ids


def test_each_stage_against_brute_force(spark):
    docs = queries.table(spark, DATA, "documents").cache()
    items = [tuple(r) for r in queries.table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    texts = lambda df: {r[0]: r[1] for r in df.select("doc_id", "text").collect()}

    kept = P.quality(spark, docs, DATA).cache()
    accepted = {r.doc_id for r in queries.op3_quality_classifier(spark, DATA).where("predicted = 1").collect()}
    assert set(texts(kept)) == accepted and kept.columns == docs.columns and 0 < len(accepted) < docs.count()

    single = P.near_duplicate(spark, kept, DATA).cache()
    assert set(texts(single)) == {d for d, _, c in brute_components(list(texts(kept).items())) if d == c}

    clean = P.decontamination(spark, single, DATA).cache()
    assert set(texts(clean)) == {r["doc_id"] for r in brute_contamination(texts(single).items(), items) if not r["contaminated"]}

    private = P.pii(spark, clean, DATA).cache()
    assert private.columns == docs.columns and private.where("n_chars <> length(text)").count() == 0 and set(texts(private)) == set(texts(clean))

    packed = [r.asDict() for r in P.packing(spark, private, DATA).collect()]
    t = texts(private)
    check_packing(list(t.items()), packed, dict(zip(t, reference_ids("byte_bpe_50k.json", list(t.values())))))
    assert {r["doc_id"] for r in packed} == set(t)


def test_run_is_the_stages_in_order(spark):
    out = P.run(spark, DATA)
    assert out.columns[:3] == ["doc_id", "piece", "start"] and out.count() > 0 and [n for n, _ in P.STAGES][0] == "quality classifier" and WORD
    assert P.ORACLE_SQL is None


@pytest.mark.parametrize("k", range(5))
def test_empty_input(spark, k):
    docs = queries.table(spark, DATA, "documents").limit(0)
    assert P.STAGES[k][1](spark, docs, DATA).count() == 0


#: Names that the operators use for columns of their own.
CLASHING = ["cid", "component", "component_id", "n", "a", "b", "bucket", "kind", "token", "sketch", "marks", "th", "w", "h", "rows", "x", "y", "score", "predicted", "pii_kinds", "_id", "piece", "length", "part", "tail", "task", "did", "tie", "wants", "cut", "number", "value"]


def crowded(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def test_stages_on_odd_rows_with_clashing_columns(spark):
    """Nulls, empty texts, repeated ids and rows, and columns named like the stages' own: rows that stay keep all their columns."""
    rows = [*ODD, ODD[7], (5, "another text with a known id", "en", "s", 3), (None, "no id here at all", None, None, 9), (None, None, None, None, None)]
    docs = crowded(spark, rows).cache()
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        kept = [r.asDict() for r in out.collect()]
        assert all(r[c] == f"own {c}" for r in kept for c in CLASHING)
        key = lambda r: repr(tuple(r[c] for c in plain.columns))
        assert sorted(map(key, kept)) == sorted(key(r.asDict()) for r in stage(spark, plain, DATA).collect())
    private = P.pii(spark, docs.drop("n_chars"), DATA)
    assert private.columns == docs.drop("n_chars").columns and private.count() == len(rows)
    packed = [r.asDict() for r in P.packing(spark, docs, DATA).collect()]
    assert len(packed) >= len(rows) and P.packing(spark, docs.limit(0), DATA).count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(9, base), (4, base + " end"), (7, "start " + base), (2, "quite another text of six words"), (None, "alone without any id"), (11, ""), (12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in P.near_duplicate(spark, docs, DATA).collect()), key=str) == sorted([4, 2, None, 11, 12], key=str)


@pytest.mark.parametrize("name", ["token counts", "fingerprints", "token files", "bytes", "join"])
def test_operators_ignore_clashing_columns(spark, name):
    from stratalens.llm import bottomk, dac, parity_join, suffix_dedup, viterbi

    make = {
        "token counts": lambda d: viterbi.count_tokens(d, viterbi.load_unigrams(queries.vocabulary("piece_bpe_32k.model"))), "fingerprints": bottomk.fingerprint_documents,
        "token files": lambda d: dac.token_table(d, queries.vocabulary("word_bpe_49k.json")), "bytes": suffix_dedup.remove_repeats, "join": parity_join.near_duplicates,
    }[name]
    docs = crowded(spark, [*ODD, ODD[7], (None, "no id here", None, None, 9)]).cache()
    key = lambda d: sorted(repr(r.asDict()) for r in d.collect())
    assert key(make(docs)) == key(make(docs.select("doc_id", "text"))) != []
