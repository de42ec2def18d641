"""Exactly-once stores, the result cache, timers, and clones: recovery, replays and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stratalens import streaming
from stratalens.operators import clones
from stratalens.streaming import store, timers

ROW = "k long, note string, n long"


@pytest.fixture
def new_store(spark, tmp_path):
    names = iter(range(100))
    return lambda: store.BatchStore(spark, f"file://{tmp_path}/s{next(names)}", ROW)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def batch(spark, *r):
    return spark.createDataFrame(list(r), ROW)


def test_replayed_and_killed_batches(spark, new_store):
    s = new_store()
    assert s.numbers() == [] and rows(s.read()) == [] and rows(s.state(("k",), ("n",))) == []
    assert s.ingest(batch(spark, (1, "a", 2), (2, None, 3)), 1)
    assert not s.ingest(batch(spark, (1, "other", 99)), 1)  # the same number again changes nothing
    s.write_rows(batch(spark, (9, "killed", 9)), 2)  # data without a manifest
    assert s.numbers() == [1] and rows(s.state(("k",), ("n",))) == [(1, "a", 2), (2, None, 3)]
    assert s.ingest(batch(spark, (1, "b", 5), (None, "null key", 1)), 2)  # the batch comes again and counts
    want = [(1, "b", 7), (2, None, 3), (None, "null key", 1)]
    assert rows(s.state(("k",), ("n",))) == want
    s.compact(("k",), ("n",))
    s.compact(("k",), ("n",))
    assert rows(s.state(("k",), ("n",))) == want and {r.batch for r in s.read().collect()} == {2}
    s.ingest(batch(spark, (2, "c", 1)), 3)
    assert rows(s.state(("k",), ("n",))) == [(1, "b", 7), (2, "c", 4), (None, "null key", 1)]


def test_two_writers_of_one_number(spark, new_store):
    s = new_store()
    a, b = s.write_rows(batch(spark, (1, "a", 1)), 5), s.write_rows(batch(spark, (1, "b", 1)), 5)
    assert s._publish("batch", 5, a) and not s._publish("batch", 5, b)
    assert rows(s.batch(5)) == [(1, "a", 1)]


def test_upsert_says_what_is_new(spark, new_store):
    s = new_store()
    assert [r.inserted for r in s.upsert(batch(spark, (1, "a", 1)), 1, ("k",), ("n",)).collect()] == [True]
    got = {r.k: (r.note, r.n, r.inserted) for r in s.upsert(batch(spark, (1, "b", 4), (2, "c", 1)), 2, ("k",), ("n",)).collect()}
    assert got == {1: ("b", 5, False), 2: ("c", 1, True)}
    again = {r.k: (r.note, r.n, r.inserted) for r in s.upsert(batch(spark, (1, "b", 4), (2, "c", 1)), 2, ("k",), ("n",)).collect()}
    assert again == got


def test_lost_rows_are_reported_and_replay_catches_up(spark, new_store):
    a, b = new_store(), new_store()
    for n in range(3):
        store.dual_write(a, b, batch(spark, (n, "x", n), (10, "shared", 1)), n)
    assert store.differences(a.state(("k",), ("n",)), b.state(("k",), ("n",)), ("k",)).collect() == []
    a.ingest(batch(spark, (7, "only here", 1), (10, "shared", 5), (None, "null", 1)), 3)  # the second write never came
    assert rows(store.differences(a.state(("k",), ("n",)), b.state(("k",), ("n",)), ("k",))) == [(10, "differs"), (7, "only_first"), (None, "only_first")]
    assert rows(store.differences(b.read(), a.read(), ("k", "batch"))) == [(10, 3, "only_second"), (7, 3, "only_second"), (None, 3, "only_second")]
    c = new_store()
    assert store.replay(a, b) == [3] and store.replay(a, b) == [] and store.replay(a, c) == [0, 1, 2, 3]
    assert rows(b.read()) == rows(a.read()) == rows(c.read())


def test_a_stream_into_a_store_that_is_stopped_and_started(spark, new_store, tmp_path):
    s, folder = new_store(), f"{tmp_path}/in"
    for n in range(2):
        batch(spark, (n, "x", 1)).coalesce(1).write.mode("append").parquet(folder)
        q = spark.readStream.schema(ROW).parquet(folder).writeStream.foreachBatch(s.sink()).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    assert s.numbers() == [0, 1] and rows(s.read().drop("batch")) == [(0, "x", 1), (1, "x", 1)]
    s.sink()(batch(spark, (0, "again", 5)), 0)  # a repeated micro-batch
    assert rows(s.read().drop("batch")) == [(0, "x", 1), (1, "x", 1)]


def at(hour):
    return F.lit(f"2024-01-01 {hour:02d}:00:00").cast("timestamp")


def test_cache_scans_only_what_changed(spark, tmp_path):
    scanned = spark.sparkContext.accumulator(0)

    def scan(d):
        def run(batches):
            for b in batches:
                scanned.add(len(b))
                yield b.assign(length=b["text"].str.len())[["doc_id", "length"]]

        return d.mapInPandas(run, "doc_id string, length long")

    cache = store.ResultCache(spark, f"file://{tmp_path}/cache", "length long", "v1")
    docs = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bbb"), (4, None), (5, "")], "doc_id long, text string")
    first = rows(cache.run(docs, scan, 1, at(0)))
    assert first == [(1, 2, False), (2, 2, False), (3, 3, False), (5, 0, False)]
    before = scanned.value
    edited = docs.withColumn("text", F.when(F.col("doc_id") == 3, "cccc").otherwise(F.col("text")))
    assert rows(cache.run(edited, scan, 2, at(6))) == [(1, 2, True), (2, 2, True), (3, 4, False), (5, 0, True)]
    assert scanned.value - before <= 2  # one content, in a plan that may run twice
    assert {r.reused for r in cache.run(edited, scan, 3, at(23), keep_hours=1).collect()} == {False}  # all entries are too old
    newer = store.ResultCache(spark, f"file://{tmp_path}/cache", "length long", "v2")
    assert newer.valid(at(23), 24).count() == 0  # other rules
    cache.evict(4, at(23), max_bytes=3)  # the entries of least age that fit: '' (0), 'aa' or 'cccc' by hash
    assert 0 < cache.valid(at(23), 24).count() < 3 and cache.valid(at(23), 24).agg(F.sum("size")).first()[0] <= 3


def streamed(spark, tmp_path, events, build):
    """The events in files of a few, in order of time."""
    folder = f"{tmp_path}/events"
    for k in range(0, len(events), 40):
        spark.createDataFrame(events[k : k + 40], "key string, at timestamp, kind string").coalesce(1).write.mode("append").parquet(folder)
    return timers.with_rocksdb(spark, lambda: streaming.drained(spark, folder, "key string, at timestamp, kind string", build, "append", maxFilesPerTrigger="1"))


def made_events():
    import datetime as dt

    rng, t, out = random.Random(5), dt.datetime(2024, 1, 1), []
    for _ in range(160):
        t += dt.timedelta(seconds=rng.randint(1, 300))
        out.append((rng.choice("abc"), t, rng.choice(["request", "answer"])))
    out.append(("z", t + dt.timedelta(days=1), "answer"))  # moves the watermark beyond all timers
    return out


def test_timeouts_of_a_stream_equal_the_batch_twin(spark, tmp_path):
    events = made_events()
    table = spark.createDataFrame(events, "key string, at timestamp, kind string")
    got = streamed(spark, tmp_path, events, lambda e: timers.answered(e, 240_000, "1 second"))
    assert rows(got) == rows(timers.answered_table(table, 240_000)) and {r.status for r in got.collect()} == {"answered", "timed_out"}


def test_flushes_by_size_and_time(spark, tmp_path):
    events = made_events()
    want, held = [], {}
    for key, t, _ in events:
        first, n = held.get(key, (t, 0))
        if n and (t - first).total_seconds() > 900:
            want.append((key, first, n, "time"))
            first, n = t, 0
        held[key] = (first, n + 1)
        if n + 1 == 4:
            want.append((key, first, 4, "size"))
            del held[key]
    want += [(k, f, n, "time") for k, (f, n) in held.items() if k != "z"]
    got = streamed(spark, tmp_path, events, lambda e: timers.flushed(e, 4, 900_000, "1 second"))
    assert rows(got) == sorted(want, key=repr)


def brute_blocks(text, size, least):
    text = "".join(p if k == 0 else re.sub(r"[^\n]", "", p.split("*/")[0]) + p[len(p.split("*/")[0]) + 2 :] for k, p in enumerate(text.split("/*")))
    lines = []
    for n, line in enumerate(re.split("\r?\n", text), 1):
        line = re.sub(r"(^|\s)//.*$|^\s*#.*$", "", line)
        toks = []
        for t in re.findall(r"""(?:"[^"]*"|'[^']*'|`[^`]*`)|[^\W\d]\w*|\$\w*|\d+(?:\.\d+)?|[^\s\w$]""", line):
            toks.append("STR" if t[0] in "\"'`" and len(t) > 1 else "KW:" + t if t in clones.KEYWORDS else "ID" if re.match(r"[^\W\d]|\$", t) else "NUM" if t[0].isdigit() else t)
        if toks:
            lines.append((n, " ".join(toks), len(toks)))
    return [(i + 1, lines[i][0], lines[i + size - 1][0], "\n".join(x[1] for x in lines[i : i + size])) for i in range(len(lines) - size + 1) if sum(x[2] for x in lines[i : i + size]) >= least]


def test_clones_equal_brute_force(spark):
    rng = random.Random(2)
    pool = ["x = y + 1;", "if (a) { b(); }", "return 'text';", "// only a comment", "", "for (const q of list) {", "}", "/* a", "block */ let z = 3;", "foo(bar, 12.5);"]
    files = [(f"f{k}.js", "\n".join(rng.choice(pool) for _ in range(60))) for k in range(6)] + [("none.js", None), ("empty.js", ""), ("one.js", "x")]
    df = spark.createDataFrame(files, "file string, content string").withColumn("tokens", F.lit(1))
    seen, links = {}, {}
    for name, text in sorted(files):
        for i, line, last, body in brute_blocks(text or "", 3, 6):
            seen.setdefault(body, []).append((name, i, line, last))
    for members in seen.values():
        f0, i0, l0, _ = min(members)
        for f, i, line, last in members:
            if f != f0 or i - i0 >= 3:
                links[f, f0, i - i0, i] = (line, last, l0)
    want = []
    for f, f0, d, i in sorted(links):
        if (f, f0, d, i - 1) in links:
            continue
        j = i
        while (f, f0, d, j + 1) in links:
            j += 1
        want.append((f, links[f, f0, d, i][0], links[f, f0, d, j][1], f0, links[f, f0, d, i][2], j - i + 1))
    b = clones.blocks(df, 3, 6)
    got = clones.regions(b, 3)
    assert sorted((r.file, r.start_line, r.end_line, r.of_file, r.of_start, r.blocks) for r in got.collect()) == sorted(want) and want
    assert sorted((r.n, r.links, r.first_file, r.first_line) for r in clones.classes(b).collect()) == sorted((len(m), len(m) - 1, min(m)[0], min(m)[2]) for m in seen.values() if len(m) > 1)
    total = clones.summary(got).first()
    assert total.clones == len(want) and total.cross_file + total.internal == len(want)
    assert clones.regions(clones.blocks(df.limit(0))).collect() == []


def test_a_block_in_many_files_gives_one_link_each(spark):
    text = "\n".join(f"call(a{', b' * k});" for k in range(1, 7))  # six lines of different shape
    df = spark.range(300).select(F.format_string("f%03d.js", "id").alias("file"), F.lit(text).alias("content"))
    found = clones.regions(clones.blocks(df)).collect()
    assert len(found) == 299 and {(r.of_file, r.start_line, r.end_line) for r in found} == {("f000.js", 1, 6)}
