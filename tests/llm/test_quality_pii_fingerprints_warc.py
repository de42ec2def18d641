import datetime as dt
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import bottomk, pairwise_quality, pseudonyms, queries, warc

from .helpers import DATA, ODD, SCHEMA, lower, rows

KEY = b"test key"


def test_op3_holds_up_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in rows(queries.op3_quality_classifier(spark, sf), "doc_id")}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in out.items())
    held = [(out[d]["score"], q) for d, q in labels.items() if d in out and out[d]["held_out"]]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def test_op3_edges(spark):
    docs = spark.createDataFrame([*ODD, ODD[2]], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = pairwise_quality.score_documents(docs, labels).collect()
    assert len(out) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in out)
    none = pairwise_quality.score_documents(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert pairwise_quality.score_documents(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    assert sorted(pseudonyms.permute(i, size, KEY, "t") for i in range(size)) == list(range(size))


def luhn_ok(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def test_formats_stay_valid():
    rng = random.Random(1)
    for _ in range(200):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        card = body + pseudonyms.luhn_digit(body)
        assert luhn_ok(card)
        text, n = pseudonyms.pseudonymise(f"pay {card} now", KEY)
        new = re.fullmatch(r"pay (\d{16}) now", text)[1]
        assert n == {"card": 1} and luhn_ok(new) and new != card
        spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
        assert pseudonyms.pseudonymise(spaced, KEY)[0].replace(" ", "") == new
    for shape, pattern in (("2024-02-29", "%Y-%m-%d"), ("31.12.1999", "%d.%m.%Y"), ("12/31/1999", "%m/%d/%Y"), ("1999/12/31", "%Y/%m/%d")):
        text, n = pseudonyms.pseudonymise(shape, KEY)
        assert n == {"date": 1} and text != shape and dt.datetime.strptime(text, pattern)
    text, n = pseudonyms.pseudonymise("GB82 WEST 1234 5698 7654 32", KEY)
    t = text.replace(" ", "")
    assert n == {"iban": 1} and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1 and t[:2] == "GB"
    for s in ("a.b7@mail.example.com", "+1 (017) 555-7713", "123-45-6789", "10.20.30.40", "0a1bf7c2" * 5, "Jörg.7@ex.org"):
        text, n = pseudonyms.pseudonymise(f"({s})", KEY)
        assert sum(n.values()) == 1 and s not in text and pseudonyms.pseudonymise(f"x {s}!!", KEY)[0] == f"x {text[1:-1]}!!"


def test_distinct_ssns_stay_distinct_and_valid():
    seen = set()
    for area in (1, 665, 667, 899):
        for serial in range(1, 60):
            new = pseudonyms.pseudonymise(f"{area:03d}-01-{serial:04d}", KEY)[0]
            assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", new)
            seen.add(new)
    assert len(seen) == 4 * 59


def test_clean_text_and_failed_validation_stay():
    for s in ("version 3.0.1.2.4 of 12", "9807915762804491", "2024-02-30", "000-12-3456", "GB83 WEST 1234 5698 7654 32", "300.1.2.3", "a@b", "deadbeef", "", "x" * 100, "1234567890123456789012345"):
        assert pseudonyms.pseudonymise(s, KEY) == (s, {})


def test_values_beside_each_other_are_all_found():
    card, phone, iban = "4111 1111 1111 1111", "415-555-2671", "BE68 5390 0754 7034"
    alone = {s: pseudonyms.pseudonymise(s, KEY)[0] for s in (card, card.replace(" ", ""), phone, iban, "97.51.17.173", "2024-01-05", "123-45-6789", "7@x.org")}
    assert all(new != s for s, new in alone.items())
    for a, new in alone.items():
        for b in ("12/27", "123", "1", "AB"):
            assert pseudonyms.pseudonymise(f"{a} {b}", KEY)[0] == f"{new} {b}", (a, b)
        for b, other in alone.items():
            assert pseudonyms.pseudonymise(f"{a} {b}", KEY)[0] == f"{new} {other}", (a, b)
            assert pseudonyms.pseudonymise(f"{a} {b} {a}", KEY)[0] == f"{new} {other} {new}", (a, b)


def test_neighbours_that_pass_luhn_together_stay_apart():
    for serial in range(200):  # a tenth of these are valid as one number of 16 digits
        a, b = f"415-555-{serial:04d}", "415-555-2671"
        want = " ".join(pseudonyms.pseudonymise(s, KEY)[0] for s in (a, b))
        assert pseudonyms.pseudonymise(f"{a} {b}", KEY) == (want, {"phone": 2})
        card = f"{serial:03d} 4111 1111 1111 1111"
        assert pseudonyms.pseudonymise(card, KEY)[0] == f"{serial:03d} " + pseudonyms.pseudonymise(card[4:], KEY)[0]


def test_op4(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    out = rows(queries.op4_pseudonyms(spark, DATA), "doc_id")
    assert len(out) == len(docs)
    for r in out:
        assert len(r["text"].split()) == len(docs[r["doc_id"]].split())
        assert (r["text"] != docs[r["doc_id"]]) == bool(r["pii_kinds"])
        for found in re.findall(r"[\w.+-]+@[\w-]+\.[\w.-]+|\+1 \(\d{3}\) \d{3}-\d{4}|\b[0-9a-f]{40}\b", docs[r["doc_id"]]):
            assert found not in r["text"]
    df = spark.createDataFrame([*ODD, ODD[0]], SCHEMA).withColumnRenamed("lang", "pii_kinds")
    odd = pseudonyms.pseudonymise_documents(df, KEY)
    assert odd.columns == [*df.columns, "pii_kinds_"] and odd.count() == len(ODD) + 1
    assert odd.where("text is null").count() == 2 and odd.where("pii_kinds_ <> ''").count() == 0
    assert sorted(r[0] or "" for r in odd.select("pii_kinds").collect()) == sorted(r[0] or "" for r in df.select("pii_kinds").collect())
    assert pseudonyms.pseudonymise_documents(df.limit(0), KEY).count() == 0


def one(value):
    """The pseudonym of a text that is one value."""
    new, n = pseudonyms.pseudonymise(value, KEY)
    assert sum(n.values()) == 1, (value, n)
    return new


def test_each_kind_is_a_bijection_in_its_format():
    """Brute force over many values of each kind: different ones stay different, and the format holds."""
    day = [dt.date(1990, 1, 1) + dt.timedelta(i) for i in range(2500)]
    layouts = {f"{d:%d/%m/%Y}" for d in day} | {f"{d:%m/%d/%Y}" for d in day}
    new = {x: one(x) for x in layouts}
    assert len(set(new.values())) == len(new)
    first = lambda x: int(x[3:5]) <= 12  # noqa: E731  readable with the day first
    assert all(first(x) == first(y) for x, y in new.items())
    assert all(one(f"{d:%Y-%m-%d}").split("-")[::-1] == one(f"{d:%d.%m.%Y}").split(".") for d in day[:200])  # linked across layouts
    plan = [f"{a}-{e}-{n:04d}" for a in (212, 989, 305, 191, 911, 290) for e in (200, 555, 999, 911, 155) for n in range(0, 9999, 77)]
    new = {x: one(x) for x in plan}
    valid = re.compile(r"[2-9](?!11)[0-8][0-9]-[2-9](?!11)[0-9][0-9]-[0-9]{4}")
    assert len(set(new.values())) == len(new) and all(bool(valid.fullmatch(x)) == bool(valid.fullmatch(y)) for x, y in new.items())
    ips = [f"10.{a}.{b}.7" for a in range(0, 256, 5) for b in range(0, 256, 5)]
    assert len({one(x) for x in ips}) == len(ips)
    names = [a + b for a in "abzéñßçüö漢字й" for b in "abzéñßçüö漢字й"]
    new = {x: one(f"{x}@example.org") for x in names}
    assert len(set(new.values())) == len(new) and all(len(y) == len(x) + 12 and y.endswith("@example.org") for x, y in new.items())
    ssn = [f"{a:03d}-{g:02d}-{n:04d}" for a in (1, 665, 667, 899) for g in (1, 50, 99) for n in range(1, 9999, 111)]
    assert len({one(x) for x in ssn}) == len(ssn)


def test_long_values_are_permuted_whole_and_keys_of_any_length_serve():
    local = "".join(random.Random(2).choice("abcdefghij") for _ in range(600))
    a, b = one(f"{local}@example.org"), one(f"{local[:-1]}z@example.org")
    for new in (a, b):
        assert max(len(run) for run in re.findall("=+", "".join("=" if x == y else "." for x, y in zip(new, local)))) < 12
    assert sum(x == y for x, y in zip(a, b)) < 60 + 12  # the last letter changes all others
    assert pseudonyms.pseudonymise("10.1.2.3", b"k" * 200)[0] != pseudonyms.pseudonymise("10.1.2.3", b"k" * 201)[0]
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise("10.1.2.3", b"")


def test_one_at_sign_in_many_letters_costs_linear_time():
    import time

    text = ("a" * 149 + "@") * 8000  # 1.2 million characters
    start = time.process_time()
    assert pseudonyms.pseudonymise(text, KEY) == (text, {})
    assert time.process_time() - start < 20


def test_op3_collects_one_row_for_each_labelled_document(spark):
    docs = spark.createDataFrame([(1, f"text {i} of many, all with one id") for i in range(300)] + [(2, "zz##"), (3, None)], "doc_id long, text string").withColumn("label", F.lit(1))
    feats = pairwise_quality.document_features(docs)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    x, y = pairwise_quality.labelled_features(feats, labels, 10)
    assert len(x) == len(y) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2, 3))
    assert pairwise_quality.score_documents(docs, labels).count() == 302


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(docs, out):
    docs = sorted(docs, key=lambda r: r[0])
    prints = {}
    for i, ((d, t), r) in enumerate(zip(docs, out, strict=True)):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        q = len(t) // 4
        new = t[: len(t) - q] + nxt[:q]
        assert r["doc_id"] == d and r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert abs(r["near_edited"] - jaccard(shingles(t), shingles(new))) < 0.15
        assert abs(r["near_next"] - jaccard(shingles(t), shingles(nxt))) < 0.15
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert r["edited_fingerprint"] == bottomk.to_text(bottomk.sketch(new.encode()))


def test_op5(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check_fingerprints(docs, rows(queries.op5_fingerprints(spark, DATA), "doc_id"))


def test_sketches_keep_the_least_hashes_of_the_set_of_shingles():
    """An independent bottom-k: one hash for each distinct shingle, computed by itself, sorted, cut."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    for n in (0, 1, 4, 5, 6, 50, 400, 3000):
        text = " ".join(rng.choice(vocabulary) for _ in range(n))
        by_shingle = {}
        for s in shingles(text):
            (h,) = bottomk.sketch(" ".join(s).encode(), 10).tolist()
            by_shingle[s] = h
        assert len(set(by_shingle.values())) == len(by_shingle)
        assert bottomk.sketch(text.encode(), 64).tolist() == sorted(by_shingle.values())[:64]
        half = text.split()
        a, b = " ".join(half[: n // 2 + 4]), " ".join(half[n // 2 :])
        if n >= 50:
            assert bottomk.merge(bottomk.sketch(a.encode(), 64), bottomk.sketch(b.encode(), 64), 64).tolist() == bottomk.sketch(text.encode(), 64).tolist()
            assert abs(bottomk.distinct(bottomk.sketch(text.encode())) / len(by_shingle) - 1) < 0.25


def test_ranges_are_dealt_by_bytes():
    sizes = {i: 1000 if i % 50 else 30_000 for i in range(400)}
    load = [0] * 8
    for part, task in bottomk._deal(sizes, 8).items():
        load[task] += sizes[part]
    assert max(load) < 1.2 * min(load)


def test_op5_followers_of_repeated_ids(spark):
    docs = [(i // 3, f"{i % 3} words of row {i} and some more of them here {i * i}") for i in range(60)] + [(None, "no id"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("part", F.lit(9)).withColumn("tail", F.lit(1)).repartition(5)
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
    want = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        want.append((d, hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
    key = lambda r: (r[0] is not None, r[0], r[1])
    assert sorted(((r.doc_id, r.edited_sha256) for r in bottomk.fingerprint_documents(df).collect()), key=key) == sorted(want, key=key)
    assert bottomk.fingerprint_documents(df.limit(0)).count() == 0


def test_op5_odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(4)
    check_fingerprints([(r[0], r[1]) for r in ODD], rows(bottomk.fingerprint_documents(df), "doc_id"))
    one = bottomk.fingerprint_documents(df.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert bottomk.fingerprint_documents(df.limit(0)).count() == 0
    assert bottomk.fingerprint_documents(spark.createDataFrame([ODD[2], ODD[2], (None, "a", None, None, None)], SCHEMA)).count() == 3


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 40, 5000).astype(np.uint64), rng.integers(0, 1 << 40, 3000).astype(np.uint64)
    b[:1500] = a[:1500]
    cut = lambda x: np.unique(x)[:256]
    assert (bottomk.merge(cut(a), cut(b)) == cut(np.concatenate([a, b]))).all()
    assert abs(bottomk.distinct(cut(a)) / 5000 - 1) < 0.2 and abs(bottomk.resemblance(cut(a), cut(b)) - 1500 / 6500) < 0.1
    assert abs(bottomk.containment(cut(b), cut(a)) - 0.5) < 0.2
    assert (bottomk.from_text(bottomk.to_text(cut(a))) == cut(a)).all() and bottomk.to_text(cut(a)[:0]) == ""


def check_warc(pages, out):
    import base64

    first = {}
    for p, _, h in pages:
        h = h or ""
        if p is not None:
            first[h] = min(first.get(h, p), p)
    want = []
    for p, _, h in pages:
        h = h or ""
        f = first.get(h)
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        revisit = f is not None and f != p
        want.append((p, len(h.encode()), digest, "revisit" if revisit else "response", f if revisit else None, None))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r.values()) for r in out), key=key) == sorted(want, key=key)


def test_op7(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    check_warc(pages, rows(queries.op7_warc(spark, DATA), "page_id"))


def test_op7_odd_rows_small_segments(spark):
    pages = [(4, "http://a b", "x" * 999), (2, None, "x" * 999), (9, "u", None), (8, "u", ""), (None, "u", "é\r\n\r\nWARC/1.1\r\n" * 30), (7, "u", "solo \0 é"), (7, "u", "solo \0 é"), (4, "v", "y" * 70)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    check_warc(pages, rows(warc.archive_round_trip(df, segment_bytes=64), "page_id"))
    assert warc.archive_round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_revisits_name_a_record_of_the_archive(spark, tmp_path, repeated):
    pages = [(i, f"http://e.org/{i}", "same " * 9000 if i % 3 else f"own {i}") for i in range(12)]
    pages += [(4, "http://e.org/again", "same " * 9000), (None, None, None), (None, "http://e.org/", "same " * 9000)] if repeated else []
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("uid", F.lit(1)).withColumn("digest", F.lit("x")).repartition(3)
    warc.write_archive(df, str(tmp_path / "w"), segment_bytes=3000)
    fields = [f for p in (tmp_path / "w").glob("part-*") for f, _ in warc.parse_records(warc.inflate(p.read_bytes()))]
    names = [f["warc-record-id"] for f in fields]
    assert len(names) == len(set(names))
    responses = {f["warc-record-id"] for f in fields if f["warc-type"] == "response"}
    revisits = [f for f in fields if f["warc-type"] == "revisit"]
    assert len(revisits) == (9 if repeated else 7) and {f["warc-refers-to"] for f in revisits} <= responses
    back = warc.read_archive(spark, str(tmp_path / "w")).collect()
    assert len(back) == len(pages) and all(r.problem is None for r in back) and {r.refers_to for r in back if r.record_type == "revisit"} == {1}


def test_segments_are_verified():
    good = [(2, b"bc", None), (1, b"a", None), (3, b"d", 4)]
    assert warc.reassemble(good) == b"abcd" and warc.reassemble(good + good[:1]) == b"abcd"
    for bad in (good[1:], [(1, b"a", None)], [(1, b"a", None), (2, b"b", 5)], [*good, (1, b"z", None)]):
        with pytest.raises(ValueError):
            warc.reassemble(bad)
    for body in (b"", b"a" * 100_000):
        assert warc.dechunked(warc.chunked(body)) == body
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_long_values_are_permuted_half_by_half(monkeypatch):
    import itertools

    monkeypatch.setattr(pseudonyms, "_LONG_MIXED", 0)
    for shape in ("01", "a0-1", "0", "--"):  # all strings of the shape are hit once
        kinds = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.isalpha() else c for c in shape]
        every = ["".join(s) for s in itertools.product(*kinds)]
        assert sorted(pseudonyms._mixed(s, KEY, "t") for s in every) == sorted(every)
    monkeypatch.undo()
    long = "ab1." * 100_000
    out = pseudonyms._pseudonym("email", long + "@x.org", KEY)
    assert out != long + "@x.org" and len(out) == len(long) + 6 and out == pseudonyms._pseudonym("email", long + "@x.org", KEY)
    assert [c.isdigit() for c in out] == [c.isdigit() for c in long + "@x.org"] and [c == "." for c in out[: len(long)]] == [c == "." for c in long]
