import hashlib
import random
import zlib

import numpy as np
import pytest

from stratalens.llm import dac, packing, queries
from stratalens.llm.tokens import encode_in_blocks

from .helpers import DATA, ODD, SCHEMA, rows

public_tokenizers = pytest.importorskip("public_tokenizers")


def reference_ids(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_the_library(spark, name):
    texts = [r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(80).collect()]
    texts += [r[1] for r in ODD] + ["a  b\n\n c\t d ", " ", "\n", "x\x1c y!\x1cz", "Σας ΟΔΟΣ", "don't I'LL we've 's", "<|endoftext|> a<|startoftext|>", "　q\xa0w\x85e", "\x00a \x00", "é é ́x", "日本 語 ñ1½"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encode_in_blocks(texts, public_tokenizers.path(name))]
    assert got == reference_ids(name, texts)


def check_packing(docs, out, ids_of, capacity=2048):
    by_doc, by_bin = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in by_doc.items():
        if len([d for d, _ in docs if d == doc]) != 1:
            continue
        pieces.sort(key=lambda r: r["piece"])
        ids = [*ids_of[doc], 0]
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert pieces[0]["start"] == 0 and sum(r["length"] for r in pieces) == len(ids)
        for a, b in zip(pieces, pieces[1:]):
            assert b["start"] == a["start"] + a["length"] and b["length"] == capacity
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_bin)


def test_op1(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    ids = dict(zip([d for d, _ in docs], reference_ids("byte_bpe_50k.json", [t for _, t in docs])))
    out = rows(queries.op1_best_fit_packing(spark, DATA), "doc_id", "piece")
    bins = check_packing(docs, out, ids)
    assert bins <= 1.02 * sum(len(v) + 1 for v in ids.values()) / 2048 + 1


def test_op1_odd_rows_and_empty_table(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([*ODD, ODD[2], (None, "null id", None, None, None)], SCHEMA)
    out = rows(packing.pack_documents(df.withColumnRenamed("lang", "length"), path), "doc_id", "piece")
    ids = dict(zip([r[0] for r in ODD], reference_ids("byte_bpe_50k.json", [r[1] for r in ODD])))
    check_packing([(r[0], r[1]) for r in [*ODD, ODD[2]]], out, ids)
    assert packing.pack_documents(df.limit(0), path).count() == 0


def item_by_item(lengths, c):
    cap, bins = c.vector(), []
    for n in sorted(lengths, reverse=True):
        want = packing.demand(n)
        open_ = [i for i, b in enumerate(bins) if (b >= want).all()]
        if open_:
            s = [float(packing._scores(bins[i], want, cap, c)) for i in open_]
            bins[open_[int(np.argmin(s))]] = bins[open_[int(np.argmin(s))]] - want
        else:
            bins.append(cap - want)
    return len(bins)


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(tokens=100, documents=4, attention=6000), packing.Capacity(tokens=100, documents=5, attention=9000, score="dot")])
def test_histogram_plan_obeys_every_capacity_and_is_as_good_as_item_by_item(capacity):
    rng = random.Random(3)
    most = min(capacity.tokens, int(capacity.attention**0.5))
    lengths = [rng.randint(1, most) if rng.random() < 0.7 else 7 for _ in range(900)]
    plan = packing.plan_bins({n: lengths.count(n) for n in set(lengths)}, capacity)
    filled = {}
    for n, segments in plan.rows.items():
        segments = [*segments, (lengths.count(n), 0, 1, 0)]
        for (r0, b0, depth, off), (r1, *_) in zip(segments, segments[1:]):
            for r in range(r0, r1):
                filled.setdefault(b0 + (r - r0) // depth, []).append((off + (r - r0) % depth * n, n))
    assert sum(map(len, filled.values())) == len(lengths) and len(filled) == plan.bins
    for items in filled.values():
        at = 0
        for off, n in sorted(items):
            assert off == at
            at += n
        assert at <= capacity.tokens and len(items) <= capacity.documents and sum(n * n for _, n in items) <= capacity.attention
    assert plan.bins <= 1.05 * item_by_item(lengths, capacity) + 1


def test_piece_that_fits_nowhere():
    with pytest.raises(ValueError):
        packing.plan_bins({50: 1}, packing.Capacity(tokens=100, attention=100))


@pytest.mark.parametrize("bits", [1, 4, 8, 11, 16])
def test_dac_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = np.concatenate([rng.integers(0, 50_000, 1500), [0, 2**32 - 1, 255, 256, 65535, 65536]]).astype(np.uint32)
    a = dac.DacArray.encode(ids, bits)
    assert (a.decode() == ids).all() and [a[i] for i in range(len(ids))] == ids.tolist()
    s = dac.Shard([4, None, 6], np.array([0, 3, 3, len(ids)], dtype=np.uint64), a, 2, 1)
    back = list(dac.Shard.read_all(s.to_bytes() + b"\n" + s.to_bytes() + b"\n"))
    assert len(back) == 2 and back[1].doc_ids == [4, None, 6] and back[1].tokens(0).tolist() == ids[:3].tolist() and back[0].part == 2
    assert len(dac.DacArray.encode(np.zeros(0, np.uint32))) == 0
    with pytest.raises(IndexError):
        a[len(ids)]


def brute_files(docs):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0]))
    start, out = 0, []
    for (d, _), ids in zip(docs, reference_ids("word_bpe_49k.json", [t for _, t in docs])):
        ids = [*ids, 2]
        out.append({"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
        start += len(ids)
    return out


def test_op8(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.op8_token_files(spark, DATA), "doc_id") == brute_files(docs)


def test_op8_odd(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([*ODD, (None, "null id", None, None, None)], SCHEMA).repartition(3)
    assert rows(dac.token_table(df, path), "doc_id") == brute_files([(r[0], r[1]) for r in ODD] + [(None, "null id")])
    assert dac.token_table(df.limit(0), path).count() == 0
