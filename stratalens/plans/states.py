"""Registered queries of stores, caches and timers, over the given tables cut into batches or read as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..operators import scan
from ..streaming import store, timers
from . import calls

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_query = calls.query


def query(sql: str):
    def add(f):
        f = _query(sql)(f)
        QUERIES[f.__name__], ORACLE[f.__name__] = calls.QUERIES.pop(f.__name__), calls.ORACLE.pop(f.__name__)
        return f

    return add


_ROW = "o_custkey long, last_order long, n_orders long, cents long"
_KEY, _ADDED = ("o_custkey",), ("n_orders", "cents")
_YEARS = "y AS (SELECT o_custkey, year(o_orderdate) AS b, max(o_orderkey) AS last_order, count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM {orders} GROUP BY o_custkey, year(o_orderdate))"
_STATE = "SELECT o_custkey, last_order, n_orders, cents FROM (SELECT o_custkey, last_order, CAST(sum(n_orders) OVER (PARTITION BY o_custkey) AS BIGINT) AS n_orders, CAST(sum(cents) OVER (PARTITION BY o_custkey) AS BIGINT) AS cents, row_number() OVER (PARTITION BY o_custkey ORDER BY b DESC) AS r FROM y) x WHERE r = 1"


def _years(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """A row for each customer and year, and the years."""
    o = calls.table(spark, sf_dir, "orders").withColumn("b", F.year("o_orderdate"))
    rows = o.groupBy("o_custkey", "b").agg(F.max("o_orderkey").alias("last_order"), F.count("*").alias("n_orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return rows, sorted(r[0] for r in o.select("b").distinct().collect())


def _new(spark: SparkSession, name: str) -> store.BatchStore:
    return store.BatchStore(spark, store.shared_folder(spark, name), _ROW)


@query(f"WITH {_YEARS} {_STATE}")
def upserted_runs(spark, sf_dir):
    """The years of the orders as batches; every other one comes twice, one is killed before its manifest, and half way all is compacted."""
    rows, years = _years(spark, sf_dir)
    s = _new(spark, "runs")
    for k, y in enumerate(years):
        s.ingest(rows.where(F.col("b") == y), y)
        if k % 2:
            s.ingest(rows.where(F.col("b") == y), y)
        if k == len(years) // 2:
            s.compact(_KEY, _ADDED)
    s.write_rows(rows, years[-1] + 1)  # killed: never published
    return s.state(_KEY, _ADDED)


@query(f"WITH {_YEARS} SELECT s.*, NOT EXISTS (SELECT 1 FROM y WHERE y.o_custkey = s.o_custkey AND y.b < (SELECT max(b) FROM y)) AS inserted FROM ({_STATE}) s WHERE s.o_custkey IN (SELECT o_custkey FROM y WHERE b = (SELECT max(b) FROM y))")
def upsert_returning(spark, sf_dir):
    """The rows that the last year's batch inserted or updated, as they stand after it."""
    rows, years = _years(spark, sf_dir)
    s = _new(spark, "runs")
    store.ingest_all(s, rows, F.col("b"), years[:-1])
    return s.upsert(rows.where(F.col("b") == years[-1]), years[-1], _KEY, _ADDED)


_LOST = "b = (SELECT min(b) FROM y) + 1 AND o_custkey % 10 = 7"


@query(f"WITH {_YEARS}, lost AS (SELECT o_custkey, count(*) AS n FROM y WHERE {_LOST} GROUP BY o_custkey) SELECT o_custkey, CASE WHEN (SELECT count(*) FROM y WHERE y.o_custkey = lost.o_custkey) = n THEN 'only_first' ELSE 'differs' END AS status FROM lost")
def dual_write_difference(spark, sf_dir):
    """Two stores are written alike but for rows that the second one loses in its second batch; the keys that differ are reported."""
    rows, years = _years(spark, sf_dir)
    a, b = _new(spark, "first"), _new(spark, "second")
    for k, y in enumerate(years):
        batch = rows.where(F.col("b") == y)
        if k == 1:
            a.ingest(batch, y)
            b.ingest(a.batch(y).where("o_custkey % 10 <> 7"), y)
        else:
            store.dual_write(a, b, batch, y)
    return store.differences(a.state(_KEY, _ADDED), b.state(_KEY, _ADDED), _KEY)


@query(f"WITH {_YEARS} SELECT o_custkey, b AS batch, last_order, n_orders, cents FROM y")
def replayed_runs(spark, sf_dir):
    """All batches of a store replayed in order into another that already holds the first of them."""
    rows, years = _years(spark, sf_dir)
    a, b = _new(spark, "first"), _new(spark, "second")
    store.ingest_all(a, rows, F.col("b"), years)
    b.ingest(a.batch(years[0]), years[0])
    store.replay(a, b)
    return b.read()


@query("""WITH old AS (SELECT DISTINCT sha256(CASE WHEN doc_id % 10 = 0 THEN 'old ' || text ELSE text END) AS h FROM {documents} WHERE text IS NOT NULL)
 SELECT f.doc_id, f.line, f.rule_id, f.severity, sha256(d.text) IN (SELECT h FROM old) AS reused FROM {findings} f JOIN {documents} d ON d.doc_id = f.doc_id""")
def cached_findings(spark, sf_dir):
    """A second run of the rules after a tenth of the documents has been edited; the others' findings come from the cache."""
    docs = calls.table(spark, sf_dir, "documents").select("doc_id", "text")
    before = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text")))
    rules = lambda d: scan.scan(d, scan.TEXT_RULES, guard=True).select("doc_id", "line", "rule_id", "severity")
    cache = store.ResultCache(spark, store.shared_folder(spark, "cache"), "line long, rule_id string, severity string", "rules 1")
    cache.run(before, rules, 1, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return cache.run(docs, rules, 2, F.lit("2024-01-01 06:00:00").cast("timestamp"))


_HOUR = 3_600_000
_AT = "date_trunc('second', ts)"


def _stream(spark: SparkSession, sf_dir: str, build, **columns: str) -> DataFrame:
    schema = calls.table(spark, sf_dir, "events").schema
    as_events = lambda s: build(s.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", *[F.expr(e).alias(n) for n, e in columns.items()]))
    return timers.with_rocksdb(spark, lambda: streaming.drained(spark, sf_dir, schema, as_events, "append", pathGlobFilter="events.parquet"))


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, {_AT} AS tm, CASE WHEN event_type = 'click' THEN 'request' ELSE 'answer' END AS kind FROM {{events}}),
 n AS (SELECT *, lead(tm) OVER w AS next_at, lead(kind) OVER w AS next_kind FROM e WINDOW w AS (PARTITION BY key ORDER BY tm, kind)),
 r AS (SELECT key, tm, next_at, coalesce(next_kind = 'answer' AND date_diff('millisecond', tm, next_at) <= {6 * _HOUR}, false) AS ok FROM n WHERE kind = 'request')
 SELECT key, tm AS asked_at, CASE WHEN ok THEN 'answered' ELSE 'timed_out' END AS status, CASE WHEN ok THEN CAST(date_diff('millisecond', tm, next_at) AS BIGINT) ELSE {6 * _HOUR} END AS waited_ms
 FROM r WHERE ok OR next_at IS NOT NULL OR tm + INTERVAL 6 HOUR <= (SELECT max(tm) FROM e) - INTERVAL 10 MINUTE""")
def stream_request_timeouts(spark, sf_dir):
    """A click of a user waits six hours for another event; those still open at the end of the stream are not out yet."""
    return _stream(spark, sf_dir, lambda e: timers.answered(e, 6 * _HOUR), key="CAST(user_id AS STRING)", at=_AT, kind="CASE WHEN event_type = 'click' THEN 'request' ELSE 'answer' END")


@query(f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, {_AT} AS tm, row_number() OVER (PARTITION BY user_id ORDER BY {_AT}) AS k FROM {{events}}),
 s AS (SELECT key, k, tm, tm AS first_at, CAST(1 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS out_at, CAST(0 AS BIGINT) AS out_n, '' AS cause FROM e WHERE k = 1
  UNION ALL SELECT e.key, e.k, e.tm, CASE WHEN late OR s.n = 0 THEN e.tm ELSE s.first_at END, CASE WHEN late OR s.n = 0 THEN 1 WHEN s.n + 1 = 5 THEN 0 ELSE s.n + 1 END,
   CASE WHEN late THEN s.first_at WHEN s.n + 1 = 5 THEN s.first_at END, CASE WHEN late THEN s.n WHEN s.n + 1 = 5 THEN 5 ELSE 0 END, CASE WHEN late THEN 'time' WHEN s.n + 1 = 5 THEN 'size' ELSE '' END
  FROM (SELECT s.*, e.tm AS now FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1) s JOIN e ON e.key = s.key AND e.k = s.k + 1, LATERAL (SELECT s.n > 0 AND s.now > s.first_at + INTERVAL 12 HOUR AS late) t)
 SELECT key, out_at AS first_at, out_n AS n, cause FROM s WHERE cause <> ''
 UNION ALL SELECT key, first_at, n, 'time' FROM s WHERE n > 0 AND k = (SELECT max(k) FROM e WHERE e.key = s.key) AND first_at + INTERVAL 12 HOUR <= (SELECT max(tm) FROM e) - INTERVAL 10 MINUTE""")
def stream_timed_flushes(spark, sf_dir):
    """The events of a user are flushed by fives, or twelve hours after the first."""
    return _stream(spark, sf_dir, lambda e: timers.flushed(e, 5, 12 * _HOUR), key="CAST(user_id AS STRING)", at=_AT)
