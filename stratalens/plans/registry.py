"""The library's registered queries and their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..operators import findings as fnd
from ..operators import scan, secrets, similarity
from ..sources import text
from . import calls, catalog, more, outcomes, states, trees

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or one of the operators that the catalogue's queries read."""
    if name == "lines":
        return text.lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    if name == "findings":  # the one place of the oversize guard, as in its SQL
        return scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), scan.TEXT_RULES, guard=True)
    if name == "html_findings":
        return scan.scan(table(spark, sf_dir, "pages").selectExpr("page_id AS doc_id", "html AS text"), scan.HTML_RULES)
    return table(spark, sf_dir, name)


def _sql(name: str, sql: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: source(spark, sf_dir, t) for t in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))})

    run.__name__ = name
    return run


for _name, _text in (catalog.SQL | more.SQL).items():
    _text = catalog.plain_numbers(_text)
    QUERIES[_name] = _sql(_name, _text)
    ORACLE[_name] = catalog.duck(_text)


for _part in (trees, calls, outcomes, states):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


@query()
def secret_scan(spark, sf_dir):
    return secrets.secrets(table(spark, sf_dir, "documents"))


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '"([^"\\s]{20,})"', 1))) AS token FROM documents),
k AS (SELECT * FROM t WHERE NOT regexp_matches(token, '^https?://') AND length(regexp_replace(token, '[\x20-\x7e]', '', 'g')) * 5 <= length(token)),
c AS (SELECT doc_id, token, ch, count(*) * 1.0 / length(token) AS p FROM (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM k) GROUP BY doc_id, token, ch)
SELECT doc_id, token, round(-sum(p * log2(p)), 4) AS entropy FROM c WHERE ch <> '' GROUP BY doc_id, token HAVING round(-sum(p * log2(p)), 4) > 3.5""")
def high_entropy_tokens(spark, sf_dir):
    """With 3.5 bits, as hexadecimal keys, the ones in the given tables, have 4 at most."""
    return scan.high_entropy_tokens(table(spark, sf_dir, "documents"), bits=3.5)


@query("SELECT doc_id, line, rule_id FROM (WITH l AS (SELECT doc_id, CAST(i AS BIGINT) AS line, parts[i] AS txt FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS r(i)) SELECT doc_id, line, 'CUSTOM_ASSIGN' AS rule_id FROM l WHERE regexp_matches(txt, 'token\\s*=\\s*\"([\\w.]+)\"') AND NOT regexp_matches(txt, 'example'))")
def custom_rule_match(spark, sf_dir):
    rule = scan.custom_rule("CUSTOM_ASSIGN", 'token = "$X"', "HIGH", pattern_not="example")
    return scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), (rule,)).select("doc_id", "line", "rule_id")


@query("""SELECT doc_id, CAST(s + 1 AS BIGINT) AS start_line, CAST(least(s + 50, n) AS BIGINT) AS end_line FROM
(SELECT doc_id, len(regexp_split_to_array(text, '\\r?\\n')) AS n FROM documents), unnest(range(0, n, 45)) AS r(s) WHERE least(s + 50, n) - s >= 5""")
def chunk_overlap(spark, sf_dir):
    return text.chunks(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "start_line", "end_line")


@query("""SELECT event_id, user_id, line, kind FROM (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS line, 'ai' AS kind FROM events WHERE event_type = 'click' UNION ALL
SELECT h.event_id, h.user_id, h.line, 'heuristic' FROM (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS line FROM events WHERE event_type = 'view') h WHERE NOT EXISTS
(SELECT 1 FROM events a WHERE a.event_type = 'click' AND a.user_id = h.user_id AND abs(CAST(floor(a.value) AS BIGINT) - h.line) <= 3))""")
def merge_tolerance_anti(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("line", F.floor("value").cast("long"))
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("event_id", "user_id", "line", F.lit(name).alias("kind"))
    return fnd.merge_with_tolerance(side("click", "ai"), side("view", "heuristic"), ("user_id",), "line", 3)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS similarity FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, vec_id, round(similarity, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s WHERE similarity >= 0.2) WHERE r <= 5""")
def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return similarity.vector_top_k(v.where("vec_id % 100 = 0"), v, 5, 0.2).withColumn("similarity", F.round("similarity", 4))


@query()
def hashed_bow_recall(spark, sf_dir):
    b = similarity.hashed_bags(table(spark, sf_dir, "documents"))
    return similarity.vector_top_k(b.where("doc_id % 100 = 0"), b, 5, 0.5, "doc_id", "vector")


@query()
def tfidf_similarity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return similarity.tfidf_search(docs, [r[0] for r in docs.where("doc_id % 100 = 0").select("doc_id").collect()])


@query()
def dbscan_clusters(spark, sf_dir):
    return similarity.density_clusters(table(spark, sf_dir, "embeddings"), 0.9)


@query("SELECT block_hash, n, n_docs, first_doc, first_line FROM (SELECT sha256(lower(trim(regexp_replace(txt, '\\s+', ' ', 'g')))) AS block_hash, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min({'d': doc_id, 'l': line}).d AS first_doc, min({'d': doc_id, 'l': line}).l AS first_line FROM (SELECT doc_id, CAST(i AS BIGINT) AS line, parts[i] AS txt FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS r(i)) WHERE length(lower(trim(regexp_replace(txt, '\\s+', ' ', 'g')))) >= 40 GROUP BY 1) WHERE n > 1")
def clone_pairs(spark, sf_dir):
    return similarity.cloned_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _events_schema(spark, sf_dir):
    return table(spark, sf_dir, "events").schema


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, count(*) AS n, CAST(count_if(event_type = 'error') AS BIGINT) AS errors, round(count_if(event_type = 'error') / count(*), 4) AS rate, count_if(event_type = 'error') / count(*) > 0.05 AS alert FROM events GROUP BY 1")
def stream_error_rate_5m(spark, sf_dir):
    return _drained(spark, sf_dir, streaming.error_rate)


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events)
SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    return _drained(spark, sf_dir, streaming.sessions)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_replay(spark, sf_dir):
    keys = lambda e: streaming.without_replays(e, ("user_id", "event_type"), "60 days")
    return _drained(spark, sf_dir, keys, "append").select("user_id", "event_type")


def _drained(spark, sf_dir, build, mode="complete"):
    """The events as a stream of Parquet files."""
    as_time = lambda e: build(e.withColumn("ts", F.col("ts").cast("timestamp")))
    folder, one = sf_dir, {"pathGlobFilter": "events.parquet"}
    return streaming.drained(spark, folder, _events_schema(spark, sf_dir), as_time, mode, **one)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT user_id, count(*) AS n, round(avg(value) * exp(-date_diff('hour', max(ts), (SELECT max(ts) FROM events)) / 168.0) + 0.1 * ln(count(*) + 1), 4) AS importance FROM events GROUP BY user_id")
def decay_rank(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    g = e.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.max("ts").alias("last")).join(now)
    hours = (F.unix_timestamp(F.date_trunc("hour", "now")) - F.unix_timestamp(F.date_trunc("hour", "last"))) / 3600
    return g.select("user_id", "n", F.round(F.col("v") * F.exp(-hours / 168.0) + 0.1 * F.log(F.col("n") + 1), 4).alias("importance"))


