"""Registered queries that are calls of library operators over the given tables, each with its own SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clamp
from ..operators import export, scan, similarity
from ..operators.ordered import running
from ..operators import findings as fnd
from ..sources import derived, text
from . import catalog

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """``sql`` is written as in the catalogue; without it the query is tested against brute force."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = catalog.duck(catalog.plain_numbers(sql))
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the text rules; the rule scan leaves oversize documents out."""
    return scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), scan.TEXT_RULES, guard=True)


@query("SELECT doc_id, CASE WHEN length(text) <= 500000 AND n <= 5000 THEN n ELSE 0 END AS lines_analyzed, NOT (length(text) <= 500000 AND n <= 5000) AS skipped FROM (SELECT doc_id, text, CAST(length(text) - length(replace(text, '\n', '')) + 1 AS BIGINT) AS n FROM {documents}) x")
def scan_coverage(spark, sf_dir):
    return scan.coverage(table(spark, sf_dir, "documents"))


@query("""SELECT doc_id, line, rule_id, priority FROM (SELECT doc_id, line, rule_id, CAST(CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 50 WHEN 'MEDIUM' THEN 20 ELSE 5 END * impact AS BIGINT) AS priority,
 row_number() OVER (PARTITION BY doc_id, line, rule_id ORDER BY col) AS r FROM {findings}) x WHERE r = 1 ORDER BY priority DESC, doc_id, line, rule_id LIMIT 10""")
def findings_dedup_priority(spark, sf_dir):
    return fnd.top(fnd.prioritise(fnd.deduplicate(found(spark, sf_dir)))).select("doc_id", "line", "rule_id", "priority")


@query("SELECT d.domain, count(f.doc_id) AS n, count(DISTINCT f.doc_id) AS n_docs FROM (VALUES ('security'), ('privacy'), ('legal'), ('refactoring'), ('testing')) AS d(domain) LEFT JOIN {findings} f ON f.domain = d.domain GROUP BY d.domain")
def domain_summary_zero_fill(spark, sf_dir):
    domains = spark.createDataFrame([(d,) for d in ("security", "privacy", "legal", "refactoring", "testing")], "domain string")
    return fnd.domain_summary(found(spark, sf_dir), domains)


@query("""WITH s AS (SELECT CAST(sum(length(text) - length(replace(text, '\n', '')) + 1) AS BIGINT) AS n_lines FROM {documents}),
 f AS (SELECT count(*) AS total, sum(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) AS critical, sum(CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END) AS high, sum(CASE WHEN severity = 'MEDIUM' THEN 1 ELSE 0 END) AS medium, sum(CASE WHEN severity = 'LOW' THEN 1 ELSE 0 END) AS low,
 count(DISTINCT doc_id) AS n_docs, sum(CASE severity WHEN 'CRITICAL' THEN 10.0 WHEN 'HIGH' THEN 5.0 WHEN 'MEDIUM' THEN 2.0 ELSE 0.5 END) AS penalty FROM {findings})
 SELECT *, round(1000.0 * total / n_lines, 4) AS per_kloc, greatest(0.0, 100.0 - penalty) AS score, CASE WHEN 100 - penalty >= 90 THEN 'A' WHEN 100 - penalty >= 80 THEN 'B' WHEN 100 - penalty >= 70 THEN 'C' WHEN 100 - penalty >= 60 THEN 'D' ELSE 'F' END AS grade FROM f, s""")
def report_summary(spark, sf_dir):
    return fnd.summary(found(spark, sf_dir), table(spark, sf_dir, "documents"), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)


@query("SELECT rule_id, CAST(sum(CASE severity WHEN 'CRITICAL' THEN 120 WHEN 'HIGH' THEN 60 WHEN 'MEDIUM' THEN 30 WHEN 'LOW' THEN 15 ELSE 5 END) AS BIGINT) AS minutes, count(*) AS n, round(sum(CASE severity WHEN 'CRITICAL' THEN 120 WHEN 'HIGH' THEN 60 WHEN 'MEDIUM' THEN 30 WHEN 'LOW' THEN 15 ELSE 5 END) / 60.0, 2) AS hours FROM {findings} GROUP BY ROLLUP (rule_id)")
def debt_by_rule(spark, sf_dir):
    return fnd.debt(found(spark, sf_dir), "rule_id")


_GATES = "(SELECT gate, (SELECT count(*) FROM {findings} WHERE severity = gate) AS value, limit_value FROM (VALUES ('CRITICAL', CAST(0 AS BIGINT)), ('HIGH', CAST(100 AS BIGINT)), ('LOW', CAST(1000000 AS BIGINT))) AS g(gate, limit_value))"
_LIMITS = {"CRITICAL": 0, "HIGH": 100, "LOW": 1_000_000}


@query(f"SELECT *, value <= limit_value AS passed FROM {_GATES} x")
def quality_gates(spark, sf_dir):
    return fnd.quality_gates(found(spark, sf_dir), _LIMITS)


@query(f"SELECT gate, '::error title=Quality Gate Failed::' || gate || ': ' || value || ' (allowed: ' || limit_value || ')' AS annotation FROM {_GATES} x WHERE value > limit_value")
def gate_annotations(spark, sf_dir):
    return export.gate_annotations(fnd.quality_gates(found(spark, sf_dir), _LIMITS))


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'O')")
def baseline_new_issues(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return fnd.new_since(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), known, ("l_orderkey",))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS signature FROM {lineitem} WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey AS signature FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity > 49)
 SELECT coalesce(a.signature, b.signature) AS signature, CASE WHEN a.signature IS NULL THEN 'added' WHEN b.signature IS NULL THEN 'fixed' ELSE 'unchanged' END AS status FROM a FULL OUTER JOIN b ON a.signature = b.signature""")
def run_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "signature")
    return fnd.run_diff(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R' AND l_quantity > 49"), "signature")


_LATEST = "SELECT o_custkey AS k, max(o_orderkey) AS h FROM {orders} o WHERE o_orderdate = (SELECT max(o_orderdate) FROM {orders} m WHERE m.o_custkey = o.o_custkey %s) GROUP BY o_custkey"
_CUT = "(SELECT max(o_orderdate) FROM {orders}) - INTERVAL '365' DAY"


@query(f"""WITH ranked AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderdate <= {_CUT} AS old FROM {{orders}}),
 o AS (SELECT o_custkey AS k, o_orderkey AS h FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM ranked WHERE old) x WHERE r = 1),
 c AS (SELECT o_custkey AS k, o_orderkey AS h FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM ranked) x WHERE r = 1)
 SELECT coalesce(o.k, c.k) AS o_custkey, CASE WHEN o.k IS NULL THEN 'new' WHEN c.k IS NULL THEN 'deleted' WHEN o.h <> c.h THEN 'changed' ELSE 'cached' END AS status FROM o FULL OUTER JOIN c ON o.k = c.k""")
def incremental_diff(spark, sf_dir):
    """Two snapshots of each customer's latest order: a year before the last day, and on it."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate").alias("last"))
    old = orders.join(last).where(F.col("o_orderdate") <= F.col("last") - F.expr("INTERVAL '365' DAY"))  # one row on the right
    state = lambda o: o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("state"))
    return fnd.snapshot_diff(state(old), state(orders), "o_custkey", "state")


@query(f"SELECT file, CAST(s + 1 AS BIGINT) AS start_line FROM (SELECT file, content, regexp_split_to_array(content, '\\r?\\n') AS p FROM ({derived.tree_sql()})), unnest(range(0, len(p), 8)) AS r(s) WHERE least(s + 10, len(p)) - s >= 5 AND file LIKE 'src/%3.js'")
def chunk_refresh(spark, sf_dir):
    """Chunks of the derived modules that a store from before an edit does not hold; the files of every tenth page were edited."""
    now = derived.files(spark, sf_dir).where("file LIKE 'src/%.js'")
    before = now.withColumn("content", F.when(F.col("file").endswith("3.js"), F.concat(F.lit("// old\n"), "content")).otherwise(F.col("content")))
    chunks = lambda f: text.chunks(f, "content", size=10, overlap=2).select("file", "start_line", "content_hash")
    return fnd.new_since(chunks(now), chunks(before), ("file", "start_line", "content_hash")).select("file", "start_line")


@query("""SELECT lang, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp * 1.0 / (tp + fp), 4) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp * 1.0 / (tp + fn), 4) ELSE 0.0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0 * tp / (2 * tp + fp + fn), 4) ELSE 0.0 END AS f1, round((tp + tn) * 1.0 / (tp + fp + fn + tn), 4) AS accuracy FROM
 (SELECT lang, sum(CASE WHEN p AND a THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p AND NOT a THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT p AND a THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT p AND NOT a THEN 1 ELSE 0 END) AS tn
 FROM (SELECT lang, n_chars < 400 AS p, quality = 0 AS a FROM {documents} JOIN {labels} USING (doc_id)) c GROUP BY ROLLUP (lang)) x""")
def confusion_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return fnd.confusion(rows, F.col("n_chars") < 400, F.col("quality") == 0, "lang")


@query("SELECT n_nationkey FROM {nation} WHERE NOT EXISTS (SELECT 1 FROM {supplier} WHERE s_nationkey = n_nationkey AND s_acctbal > 8000)")
def graph_orphans(spark, sf_dir):
    edges = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"))
    return similarity.orphans(table(spark, sf_dir, "nation"), edges, "n_nationkey")


@query("SELECT node, count(DISTINCT other) AS degree FROM (SELECT l_suppkey AS node, -1 - l_partkey AS other FROM {lineitem} UNION ALL SELECT -1 - l_partkey, l_suppkey FROM {lineitem}) x GROUP BY node HAVING count(DISTINCT other) >= 5")
def graph_hubs(spark, sf_dir):
    return similarity.hubs(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst")))


@query("WITH e AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey) SELECT x.a AS src, count(DISTINCT y.a) AS reached FROM e x JOIN e y ON x.b = y.b GROUP BY x.a")
def multi_hop_reach(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return similarity.two_hop_reach(lines.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("SELECT f.doc_id, f.line, f.rule_id, count(*) AS context_lines, CAST(sum(length(l.txt)) AS BIGINT) AS context_chars FROM {findings} f JOIN {lines} l ON l.doc_id = f.doc_id AND l.line BETWEEN f.line - 2 AND f.line + 2 WHERE f.severity = 'CRITICAL' GROUP BY f.doc_id, f.line, f.rule_id")
def finding_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    critical = found(spark, sf_dir).where("severity = 'CRITICAL'").select("doc_id", "line", "rule_id")
    around = scan.with_context(text.lines(docs.join(critical.select("doc_id").distinct(), "doc_id", "left_semi")))
    n = F.length("context") - F.length(F.replace("context", F.lit("\n"), F.lit("")))
    return critical.join(around, ["doc_id", "line"]).select("doc_id", "line", "rule_id", (n + 1).cast("long").alias("context_lines"), (F.length("context") - n).cast("long").alias("context_chars"))


@query("SELECT doc_id, line, coalesce(contains(prev, 'Licensed under'), false) AS suppressed FROM (SELECT doc_id, line, txt, lag(txt) OVER (PARTITION BY doc_id ORDER BY line) AS prev FROM {lines}) x WHERE length(txt) > 140")
def suppressed_findings(spark, sf_dir):
    """The directive is looked up on the line before; in prose a licence phrase stands for it."""
    rows = text.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scan.with_suppressions(rows, marker="Licensed under").where(F.length("txt") > 140).select("doc_id", "line", "suppressed")


@query("SELECT doc_id, ifs, loops, functions, tries, ifs + loops + functions + 2 * tries AS complexity, CASE WHEN ifs + loops + functions + 2 * tries < 10 THEN 'low' WHEN ifs + loops + functions + 2 * tries < 30 THEN 'medium' ELSE 'high' END AS level FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '\\bif\\b')) AS BIGINT) AS ifs, CAST(len(regexp_extract_all(text, '\\b(?:for|while)\\b')) AS BIGINT) AS loops, CAST(len(regexp_extract_all(text, '\\bfunction\\b|=>')) AS BIGINT) AS functions, CAST(len(regexp_extract_all(text, '\\b(?:try|catch)\\b')) AS BIGINT) AS tries FROM {documents}) x")
def code_complexity(spark, sf_dir):
    return scan.complexity(table(spark, sf_dir, "documents"))


@query("SELECT item_id, text FROM {benchmark} WHERE item_id NOT IN (SELECT doc_id FROM {documents}) UNION ALL SELECT doc_id, text FROM {documents}")
def upserted_items(spark, sf_dir):
    changes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return export.upserted(table(spark, sf_dir, "benchmark").select("item_id", "text"), changes, "item_id")


@query("SELECT l_orderkey, l_linenumber, round(least(greatest(0.4 * CASE WHEN l_discount = 0 THEN 0.5 ELSE l_discount * 10 END + 0.2 * CASE WHEN l_tax = 0 THEN 0.5 ELSE l_tax * 10 END + 0.15 * 0.5 + 0.15 * l_quantity / 50.0 + 0.1 * 0.5, 0.0), 1.0), 6) AS score FROM {lineitem}")
def confidence_scores(spark, sf_dir):
    none = F.lit(None).cast("double")
    score = fnd.confidence(F.col("l_discount") * 10, F.col("l_tax") * 10, none, F.col("l_quantity") / 50.0, none)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(clamp(score, 0.0, 1.0), 6).alias("score"))


@query("""WITH RECURSIVE o AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS c, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM {part} WHERE p_size <= 2400),
 f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(2400 AS BIGINT) AS room, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS taken UNION ALL
 SELECT o.i, CASE WHEN o.c <= f.room AND f.n < 20 THEN f.room - o.c ELSE f.room END, CASE WHEN o.c <= f.room AND f.n < 20 THEN f.n + 1 ELSE f.n END, CASE WHEN o.c <= f.room AND f.n < 20 THEN o.p_partkey END FROM f JOIN o ON o.i = f.i + 1)
 SELECT CAST(n - 1 AS INT) AS position, taken AS p_partkey FROM f WHERE taken IS NOT NULL""")
def sprint_knapsack(spark, sf_dir):
    return fnd.knapsack(table(spark, sf_dir, "part"), 2400, 20, "p_size", "p_retailprice", "p_partkey")


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {events}),
 f AS (SELECT user_id, i, n, floor(value * 1000 + 0.5) / 1000.0 AS risk FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.n, floor((f.risk * 0.7 + e.value * (1 - 0.7)) * 1000 + 0.5) / 1000.0 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
 SELECT user_id, n, risk FROM f WHERE i = n""")
def profile_ewma(spark, sf_dir):
    return fnd.ewma(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("""WITH RECURSIVE v AS (SELECT 'f' || (conv_id % 50) AS file, turn AS line, role AS provider FROM {conversations}), d AS (SELECT DISTINCT file, line FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS i FROM d),
 a AS (SELECT file, line, i, line AS anchor FROM r WHERE i = 1 UNION ALL SELECT r.file, r.line, r.i, CASE WHEN r.line - a.anchor <= 3 THEN a.anchor ELSE r.line END FROM a JOIN r ON r.file = a.file AND r.i = a.i + 1),
 n AS (SELECT count(DISTINCT provider) AS n_providers FROM v)
 SELECT file, 'issue' AS category, anchor, providers, weight, n_providers, providers / n_providers AS agreement, providers / n_providers >= 0.66 AS accepted FROM
 (SELECT v.file, anchor, count(DISTINCT provider) AS providers, CAST(count(*) AS DOUBLE) AS weight FROM v JOIN a ON a.file = v.file AND a.line = v.line GROUP BY v.file, anchor) g, n""")
def ensemble_consensus(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return fnd.consensus(c.select(F.concat(F.lit("f"), F.col("conv_id") % 50).alias("file"), F.lit("issue").alias("category"), F.col("turn").cast("long").alias("line"), F.col("role").alias("provider"), F.lit(1.0).alias("weight")))


@query("""SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT DISTINCT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS passage FROM {benchmark}) b
 JOIN (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS body FROM {documents}) d ON contains(body, passage) WHERE length(passage) > 2 GROUP BY item_id""".replace("{L}", "{{L}}").replace("{N}", "{{N}}").replace("{{L}}", "L").replace("{{N}}", "N"))
def benchmark_passages(spark, sf_dir):
    """Benchmark items at any place of a document; benchmark_contamination compares whole lines only."""
    return similarity.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LEVEL = "CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END"
_FIRST = f"(SELECT rule_id, severity, row_number() OVER (ORDER BY doc_id, line, col, rule_id) - 1 AS rule_index, {_LEVEL} AS level FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY doc_id, line, col) AS r FROM {{findings}}) q WHERE r = 1)"


@query(f"SELECT CAST(rule_index AS BIGINT) AS rule_index, rule_id, level, CASE severity WHEN 'CRITICAL' THEN '9.5' WHEN 'HIGH' THEN '7.5' WHEN 'MEDIUM' THEN '5.0' WHEN 'LOW' THEN '2.5' ELSE '0' END AS security_severity FROM {_FIRST} f")
def sarif_rules(spark, sf_dir):
    return export.sarif_rules(found(spark, sf_dir)).drop("name")


@query(f"SELECT g.doc_id, g.line, g.col, g.rule_id, CAST(f.rule_index AS BIGINT) AS rule_index, f.level, 'doc/' || g.doc_id AS uri, g.col + 1 AS start_column, g.end_col + 1 AS end_column FROM {{findings}} g JOIN {_FIRST} f ON f.rule_id = g.rule_id")
def sarif_located(spark, sf_dir):
    return export.sarif_located(found(spark, sf_dir))


@query("SELECT DISTINCT 'doc/' || doc_id AS uri FROM {findings}")
def sarif_artifacts(spark, sf_dir):
    return export.sarif_artifacts(found(spark, sf_dir))


@query("""SELECT doc_id, line, rule_id, '{"ruleId":"' || rule_id || '","level":"' || %s || '","message":{"text":"' || message || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"doc/' || doc_id || '"},"region":{"startLine":' || line || ',"startColumn":' || (col + 1) || ',"endColumn":' || (end_col + 1) || '}}}]}' AS result FROM {findings}""" % _LEVEL)
def sarif_export(spark, sf_dir):
    return export.sarif_results(found(spark, sf_dir))


@query("""SELECT event_id, event_type, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total,
 count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM {events}""")
def provider_cost_running(spark, sf_dir):
    r = running(table(spark, sf_dir, "events"), ["ts", "event_id"], F.to_date("ts"), ("event_type",), total=("sum", "value"), n=("count", "*"))
    return r.select("event_id", "event_type", F.round("total", 2).alias("total"), "n")


@query("SELECT event_id, event_type, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 50.0) AS BIGINT) AS wave FROM {events}")
def wave_assignment(spark, sf_dir):
    r = running(table(spark, sf_dir, "events"), ["event_id"], F.floor(F.col("event_id") / 4096), ("event_type",), n=("count", "*"))
    return r.select("event_id", "event_type", F.floor((F.col("n") - 1) / 50).cast("long").alias("wave"))


@query("SELECT batch, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 10.0) AS BIGINT) AS batch FROM {events}) x GROUP BY batch")
def count_flush_batches(spark, sf_dir):
    r = running(table(spark, sf_dir, "events"), ["event_id"], F.floor(F.col("event_id") / 4096), n=("count", "*"))
    return r.groupBy(F.floor((F.col("n") - 1) / 10).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT event_id, lag_s > 3600 AS late FROM (SELECT event_id, CASE WHEN max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - INTERVAL '1' HOUR > ts THEN 3601 ELSE 0 END AS lag_s FROM {events}) x")
def late_events_rejected(spark, sf_dir):
    r = running(table(spark, sf_dir, "events"), ["event_id"], F.floor(F.col("event_id") / 4096), latest=("max", "ts"))
    return r.select("event_id", (F.col("latest") - F.expr("INTERVAL '1' HOUR") > F.col("ts")).alias("late"))


@query("SELECT doc_id, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM {documents}) x WHERE running <= 750000")
def halting_limits(spark, sf_dir):
    r = running(table(spark, sf_dir, "documents"), ["doc_id"], F.floor(F.col("doc_id") / 1024), total=("sum", "n_chars"))
    return r.where("total <= 750000").select("doc_id", F.col("total").cast("long").alias("running"))


@query("SELECT s.role AS subscriber, count(*) AS delivered FROM {conversations} m JOIN (SELECT DISTINCT role FROM {conversations}) s ON s.role <> m.role GROUP BY s.role")
def pub_sub_fan_out(spark, sf_dir):
    """Each message goes to every subscriber but its own role: counted per role before subscribers are joined, a row each."""
    sent = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"))
    pairs = sent.select(F.col("role").alias("subscriber")).join(sent, F.col("subscriber") != F.col("role"))
    return pairs.groupBy("subscriber").agg(F.sum("n").alias("delivered"))
