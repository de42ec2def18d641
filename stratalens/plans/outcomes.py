"""Registered queries of ``operators.learning``, over the given tables read as outcomes, incidents and fixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import learning, prediction
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


def _outcomes(spark, sf_dir):
    return calls.table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("category"), (F.col("value") / 100).alias("score"), (F.col("user_id") % 2 == 0).alias("accepted"))


_STEPS = """RECURSIVE few AS (SELECT event_type AS category, value / 100 AS score, user_id % 2 = 0 AS accepted, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 500),
 s AS (SELECT category, CASE WHEN accepted THEN 1.0 ELSE 0.0 END - coalesce(nullif(score, 0), 0.5) AS e, row_number() OVER (PARTITION BY category ORDER BY place) AS i, count(*) OVER (PARTITION BY category) AS n FROM few),
 f AS (SELECT category, i, n, greatest(0.5, least(1.5, 1.0 + 0.1 * e)) AS factor FROM s WHERE i = 1 UNION ALL SELECT s.category, s.i, s.n, greatest(0.5, least(1.5, f.factor + 0.1 * s.e)) FROM f JOIN s ON s.category = f.category AND s.i = f.i + 1)"""


@query(f"WITH {_STEPS} SELECT category, n, round(factor, 6) AS factor FROM f WHERE i = n")
def trained_factors(spark, sf_dir):
    return learning.category_factors(_outcomes(spark, sf_dir), [F.desc("ts"), F.desc("event_id")])


@query("SELECT category, CASE WHEN n IS NULL THEN f ELSE least(f * pow(1.15, n), 2.0) END AS factor FROM (SELECT c.category, CASE WHEN c.category = 'view' THEN 0.7 ELSE 1.0 END AS f, n FROM (SELECT DISTINCT event_type AS category FROM {events}) c LEFT JOIN (SELECT event_type AS category, count(*) AS n FROM {events} GROUP BY event_type) i ON i.category = c.category) x WHERE n IS NOT NULL OR category = 'view'")
def boosted_factors(spark, sf_dir):
    factors = spark.createDataFrame([("view", 0.7)], "category string, factor double")
    return learning.boosted(factors, calls.table(spark, sf_dir, "events").select(F.col("event_type").alias("category")))


@query("""SELECT cluster, CASE WHEN paths = 1 THEN 'localized' WHEN kinds = 1 THEN 'systemic' ELSE 'distributed' END AS cause, CASE WHEN paths = 1 THEN path WHEN kinds = 1 THEN kind ELSE '' END AS at, CASE WHEN paths = 1 THEN 0.8 WHEN kinds = 1 THEN 0.7 ELSE 0.3 END AS confidence FROM
 (SELECT l_partkey AS cluster, count(DISTINCT l_suppkey % 3) AS paths, count(DISTINCT l_returnflag) AS kinds, 'src/' || min(l_suppkey % 3) || '/*.js' AS path, min(l_returnflag) AS kind FROM {lineitem} GROUP BY l_partkey) x""")
def root_causes(spark, sf_dir):
    rows = calls.table(spark, sf_dir, "lineitem")
    file = F.concat(F.lit("src/"), (F.col("l_suppkey") % 3).cast("string"), F.lit("/f"), F.col("l_linenumber").cast("string"), F.lit(".js"))
    return learning.root_causes(rows.select(F.col("l_partkey").alias("cluster"), F.col("l_returnflag").alias("category"), file.alias("file")))


@query("""WITH c AS (SELECT domain AS category, count(*) AS size FROM {findings} GROUP BY domain), x AS (SELECT doc_id, line, rule_id, round(CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 50 WHEN 'MEDIUM' THEN 20 ELSE 5 END * impact + CASE WHEN size > 2 THEN 10 * ln(CAST(size AS DOUBLE)) ELSE 0.0 END, 4) AS score, CASE WHEN domain = 'privacy' THEN 0.9 ELSE 0.5 END AS confidence FROM {findings} f JOIN c ON c.category = f.domain)
 SELECT *, CASE WHEN score * confidence > 100 THEN 'CRITICAL' WHEN score * confidence > 50 THEN 'HIGH' WHEN score * confidence > 20 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM x""")
def ranked_recommendations(spark, sf_dir):
    found = calls.found(spark, sf_dir).withColumnRenamed("domain", "category")
    sizes = found.groupBy("category").agg(F.count("*").alias("size"))
    fixers = spark.createDataFrame([("privacy", 0.9)], "category string, mean double")
    return learning.ranked_recommendations(found, sizes, fixers).select("doc_id", "line", "rule_id", "score", "confidence", "priority")


@query("SELECT provider, score, row_number() OVER (ORDER BY score DESC, provider) AS place FROM (SELECT s_nationkey AS provider, round(0.6 * avg(CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0.0 END) + 0.4 * avg(s_suppkey % 100) / 100, 6) AS score FROM {supplier} GROUP BY s_nationkey) x")
def ranked_providers(spark, sf_dir):
    s = calls.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("provider")).agg(F.avg(F.when(F.col("s_acctbal") > 0, 1.0).otherwise(0.0)).alias("success_rate"), F.avg(F.col("s_suppkey") % 100).alias("confidence"))
    return learning.ranked_providers(s)


@query("SELECT event_type AS category, count(*) AS failures FROM {events} WHERE NOT value > 40 AND event_type IS NOT NULL GROUP BY event_type ORDER BY failures DESC, category LIMIT 5")
def failing_categories(spark, sf_dir):
    return learning.failing_categories(calls.table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (F.col("value") > 40).alias("success")))


@query("SELECT event_id, severity FROM (SELECT event_id, CASE WHEN value > 90 THEN 'CRITICAL' WHEN value > 60 THEN 'HIGH' WHEN value > 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM {events} WHERE event_type = 'error') x WHERE severity IN ('MEDIUM', 'LOW') ORDER BY event_id LIMIT 25")
def auto_remediated(spark, sf_dir):
    e = calls.table(spark, sf_dir, "events").where("event_type = 'error'")
    severity = F.when(F.col("value") > 90, "CRITICAL").when(F.col("value") > 60, "HIGH").when(F.col("value") > 30, "MEDIUM").otherwise("LOW")
    return learning.auto_remediated(e.select("event_id", severity.alias("severity")), ["event_id"], F.floor(F.col("event_id") / 4096), 25)


@query("SELECT event_id, user_id, event_type, sha256('=' || event_id || chr(31) || '=' || user_id || chr(31) || '=' || event_type) AS integrity FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 1000")
def audit_ring(spark, sf_dir):
    e = calls.table(spark, sf_dir, "events")
    kept = learning.audit_ring(e.select("ts", "event_id", "user_id", "event_type"), [F.desc("ts"), F.desc("event_id")], 1000).drop("ts", "integrity")
    return kept.withColumn("integrity", learning.integrity(kept.columns))


@query("""SELECT p_partkey, score, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.75 THEN 'medium' ELSE 'low' END AS level FROM (SELECT p_partkey, round(0.3 * (CASE WHEN p_brand LIKE '%1' THEN 1.0 WHEN p_brand LIKE '%2' THEN 0.7 ELSE 0.5 END * CASE WHEN p_partkey % 5 <= 1 THEN 1.0 WHEN p_partkey % 5 <= 3 THEN 0.9 ELSE 0.7 END)
 + 0.25 * CASE WHEN p_size <= 5 THEN 1.0 WHEN p_size <= 10 THEN 0.8 WHEN p_size <= 15 THEN 0.6 WHEN p_size <= 20 THEN 0.4 ELSE 0.2 END + 0.2 * 0.5 + 0.15 * 1.0 + 0.1 * 0.5, 6) AS score FROM {part}) x""")
def fix_confidence(spark, sf_dir):
    match = F.when(F.col("p_brand").endswith("1"), "exact").when(F.col("p_brand").endswith("2"), "partial").otherwise("fuzzy")
    score, level = learning.fix_confidence(match, F.col("p_partkey") % 5, F.col("p_size"), F.lit(0.5), F.lit(1.0), F.lit(0.5))
    return calls.table(spark, sf_dir, "part").select("p_partkey", score.alias("score"), level.alias("level"))


@query("SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.2f B', floor(b * 1.0 * 100 + 0.5) / 100.0) WHEN b < 1048576 THEN printf('%.2f KB', floor(b / 1024.0 * 100 + 0.5) / 100.0) WHEN b < 1073741824 THEN printf('%.2f MB', floor(b / 1048576.0 * 100 + 0.5) / 100.0) ELSE printf('%.2f GB', floor(b / 1073741824.0 * 100 + 0.5) / 100.0) END AS size, CAST(len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: length(w) > 2)) AS BIGINT) AS words FROM (SELECT doc_id, text, octet_length(encode(text)) AS b FROM {documents}) x")
def document_sizes(spark, sf_dir):
    d = calls.table(spark, sf_dir, "documents")
    return d.select("doc_id", learning.format_bytes(F.octet_length("text")).alias("size"), F.size(learning.memory_tokens(F.col("text"))).cast("long").alias("words"))


@query("SELECT conv_id, turn FROM {conversations} WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'and')")
def message_search(spark, sf_dir):
    return learning.full_text_search(calls.table(spark, sf_dir, "conversations"), "text", ["The", "and"]).select("conv_id", "turn")


#: A report of one test for each event, in the form of one of four runners.
_REPORT = {
    "jest": "named_struct('testResults', array(named_struct('name', file, 'assertionResults', array(named_struct('title', title, 'ancestorTitles', array(suite, 'small'), 'status', state, 'failureMessages', array('no', error))))))",
    "mocha": "named_struct('tests', array(named_struct('title', title, 'file', file, 'fullTitle', suite, 'state', state, 'err', named_struct('message', error))))",
    "pytest": "named_struct('tests', array(named_struct('nodeid', title, 'location', array(file, '3', suite), 'outcome', state, 'longrepr', error)))",
    "generic": "array(named_struct('test', title, 'filePath', file, 'describe', suite, 'status', state, 'message', error))",
}


@query("""SELECT name, file, CASE kind WHEN 0 THEN suite || ' > small' ELSE suite END AS suite, state = 'passed' AS passed, CASE kind WHEN 0 THEN 'no' || chr(10) || error ELSE error END AS error FROM
 (SELECT event_id % 4 AS kind, 'test ' || event_id AS name, 'src/u' || user_id || '.test.js' AS file, event_type AS suite, CASE WHEN value > 50 THEN 'failed' ELSE 'passed' END AS state, 'at ' || user_id AS error FROM {events}) x""")
def test_reports(spark, sf_dir):
    """A report per event, written as JSON by Spark and read again as results."""
    e = calls.table(spark, sf_dir, "events").selectExpr("event_id % 4 AS kind", "'test ' || event_id AS title", "'src/u' || user_id || '.test.js' AS file", "event_type AS suite", "CASE WHEN value > 50 THEN 'failed' ELSE 'passed' END AS state", "'at ' || user_id AS error")
    bodies = [e.where(F.col("kind") == k).select(F.lit(name).alias("format"), F.to_json(F.expr(body)).alias("body")) for k, (name, body) in enumerate(_REPORT.items())]
    return learning.test_results(reduce(DataFrame.unionByName, bodies))


@query("""SELECT event_id, error_type, CASE error_type WHEN 'SqlError' THEN 'DATABASE' WHEN 'AuthError' THEN 'SECURITY' WHEN 'NullError' THEN 'RELIABILITY' WHEN 'TimeoutError' THEN 'PERFORMANCE' WHEN 'HeapError' THEN 'PERFORMANCE' ELSE 'RELIABILITY' END AS category FROM
 (SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'SqlError' WHEN 1 THEN 'AuthError' WHEN 2 THEN 'NullError' WHEN 3 THEN 'TimeoutError' WHEN 4 THEN 'HeapError' ELSE 'OddError' END AS error_type FROM {events}) x""")
def inferred_categories(spark, sf_dir):
    """The error of each event goes by its user."""
    kinds = F.array(*[F.lit(x) for x in ("SqlError", "AuthError", "NullError", "TimeoutError", "HeapError", "OddError")])
    e = calls.table(spark, sf_dir, "events").select("event_id", F.element_at(kinds, (F.col("user_id") % 6).cast("int") + 1).alias("error_type"))
    return e.select("event_id", "error_type", learning.inferred_category(F.col("error_type")).alias("category"))


_RUNS = "runs AS (SELECT DISTINCT o_custkey AS project, o_orderkey AS run, l_returnflag || l_linestatus AS category FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey)"
_FORETOLD = f"""WITH {_RUNS}, now AS (SELECT project, run, category, dense_rank() OVER (PARTITION BY project ORDER BY run) AS i FROM runs),
 steps AS (SELECT a.project, a.i, a.category AS was, b.category AS nxt FROM now a JOIN now b ON b.project = a.project AND b.i = a.i + 1 WHERE a.category <> b.category),
 pairs AS (SELECT DISTINCT project, was, nxt FROM steps), final AS (SELECT project, max(i) AS last FROM now GROUP BY project),
 seen AS (SELECT a.project, a.i, a.run, p.was, p.nxt, coalesce(sum(CASE WHEN s.nxt IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY a.project, p.was, p.nxt ORDER BY a.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n
  FROM now a JOIN final f ON f.project = a.project AND a.i < f.last JOIN pairs p ON p.project = a.project AND p.was = a.category LEFT JOIN steps s ON s.project = a.project AND s.i = a.i AND s.was = p.was AND s.nxt = p.nxt),
 shares AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY project, i, was) > 0 THEN n * 1.0 / sum(n) OVER (PARTITION BY project, i, was) ELSE 0.0 END AS p FROM seen),
 told AS (SELECT project, i, run, nxt AS category, round(CAST(sum(p) AS DOUBLE), 6) AS score FROM shares GROUP BY project, i, run, nxt HAVING round(CAST(sum(p) AS DOUBLE), 6) >= 0.5),
 foretold AS (SELECT t.project, t.run, t.category, t.score, n.project IS NOT NULL AS came FROM told t LEFT JOIN now n ON n.project = t.project AND n.i = t.i + 1 AND n.category = t.category)"""


def _order_runs(spark, sf_dir):
    lines = calls.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.concat("l_returnflag", "l_linestatus").alias("category"))
    return calls.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("run")).join(lines, "run")


@query(f"{_FORETOLD} SELECT project, run, category, score, came FROM foretold")
def foretold_categories(spark, sf_dir):
    """The orders of a customer as runs, their kinds of lines as categories."""
    return prediction.predictions(_order_runs(spark, sf_dir))


@query(f"{_FORETOLD} SELECT (SELECT count(*) FROM foretold) AS predicted, (SELECT count(*) FROM foretold WHERE came) AS \"right\", (SELECT count(*) FROM now WHERE i > 1) AS came, (SELECT round(sum(CASE WHEN came THEN 1 ELSE 0 END) * 1.0 / count(*), 4) FROM foretold) AS precision, (SELECT round((SELECT count(*) FROM foretold WHERE came) * 1.0 / count(*), 4) FROM now WHERE i > 1) AS recall")
def prediction_quality(spark, sf_dir):
    runs = _order_runs(spark, sf_dir)
    return prediction.quality(prediction.predictions(runs), runs)


_TESTS = "tests AS (SELECT 'test u' || user_id || ' ' || event_type || ' ' || event_id AS test, CASE WHEN value > 50 THEN event_type END AS keyword FROM {events})"


@query(f"""WITH {_TESTS}, parts AS (SELECT test, unnest(list_distinct(list_filter(regexp_split_to_array(lower(test), '[^a-z0-9]+'), lambda x: x <> ''))) AS base FROM tests),
 by_part AS (SELECT base, min(test) AS t FROM parts GROUP BY base HAVING count(*) = 1), by_word AS (SELECT keyword, min(test) AS t FROM tests WHERE keyword IS NOT NULL GROUP BY keyword),
 scores AS (SELECT o_orderkey AS score_id, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE '' END || o_orderkey AS base, CASE WHEN o_custkey % 2 = 0 THEN 'click' END AS keyword FROM {{orders}})
 SELECT score_id, CASE WHEN p.t IS NOT NULL THEN 'unique' WHEN w.t IS NOT NULL THEN 'keyword' ELSE 'suite' END AS kind, coalesce(p.t, w.t) AS test FROM scores s LEFT JOIN by_part p ON p.base = lower(s.base) LEFT JOIN by_word w ON w.keyword = s.keyword""")
def matched_tests(spark, sf_dir):
    """Orders as scores and events as tests; a base is unique where one event alone has it in its name."""
    tests = calls.table(spark, sf_dir, "events").selectExpr("'test u' || user_id || ' ' || event_type || ' ' || event_id AS test", "CASE WHEN value > 50 THEN event_type END AS keyword")
    scores = calls.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS score_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE '' END || o_orderkey AS base", "CASE WHEN o_custkey % 2 = 0 THEN 'click' END AS keyword")
    return prediction.matched_tests(scores, tests)
