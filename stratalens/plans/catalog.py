"""Relational queries as SQL that Spark and DuckDB both read.

``{name}`` is a table.  ``{lines}``, ``{findings}``, ``{hits}`` are the library's operators on the Spark
side and common table expressions on the other.  ``#e`` marks a regular expression literal.
"""

from __future__ import annotations

from ..operators.scan import TEXT_RULES

#: name: SQL.  All counts are BIGINT, doubles are rounded.
SQL: dict[str, str] = {}

SQL["top_categories"] = "SELECT event_type, count(*) AS n FROM {events} WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3"
SQL["project_top_categories"] = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_projects FROM {events} GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10"
SQL["fix_success_having"] = """SELECT c_mktsegment AS category, count(*) AS attempts, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS successes,
 round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 4) AS success_rate FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment HAVING count(*) >= 2"""
SQL["provider_stats"] = """SELECT s_nationkey AS provider, count(*) AS n, round(avg(l_discount), 4) AS avg_confidence, round(sum(l_extendedprice), 2) AS cost,
 round(100.0 * sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) / count(*), 4) AS success_pct FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY s_nationkey"""
SQL["run_finding_join"] = """SELECT o_orderkey AS run_id, l_linenumber AS finding, l_returnflag AS category FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
 WHERE o_orderdate >= (SELECT max(o_orderdate) FROM {orders}) - INTERVAL '30' DAY"""
SQL["run_totals"] = "SELECT count(*) AS runs, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS largest FROM {orders}"
SQL["findings_by_pair"] = "SELECT l_returnflag AS category, l_linestatus AS severity, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM {lineitem} GROUP BY l_returnflag, l_linestatus"
SQL["store_totals"] = "SELECT (SELECT count(*) FROM {orders}) AS runs, (SELECT count(*) FROM {lineitem}) AS findings, (SELECT count(DISTINCT c_nationkey) FROM {customer}) AS nations"
SQL["quality_trend_delta"] = """SELECT day, score, round(score - lag(score) OVER (ORDER BY day), 4) AS delta FROM
 (SELECT CAST(ts AS DATE) AS day, round(avg(value), 4) AS score FROM {events} GROUP BY CAST(ts AS DATE)) d ORDER BY day DESC LIMIT 30"""
SQL["histogram_confidence"] = """WITH b AS (SELECT CAST(least(floor((value - lo) / nullif(hi - lo, 0) * 10), 9) AS BIGINT) AS bin FROM {events}, (SELECT min(value) AS lo, max(value) AS hi FROM {events}) m),
 d AS (SELECT CAST(k AS BIGINT) AS bin FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS v(k))
 SELECT d.bin, count(b.bin) AS n FROM d LEFT JOIN b ON d.bin = b.bin GROUP BY d.bin"""
SQL["factor_correlation"] = """SELECT round(corr(l_quantity, l_extendedprice), 4) AS corr_quantity, round(corr(l_discount, l_extendedprice), 4) AS corr_discount,
 round(avg(l_quantity), 4) AS mean_quantity, round(stddev_pop(l_quantity), 4) AS std_quantity FROM {lineitem}"""
# Sums of whole numbers, divided once and rounded as whole numbers, so that no tie depends on an engine.
SQL["calibration_error"] = """WITH p AS (SELECT CAST(least(n_chars, 20000) AS BIGINT) AS c, CAST(quality AS BIGINT) AS correct FROM {documents} JOIN {labels} USING (doc_id)),
 b AS (SELECT CAST(least(floor(c / 2000.0), 9) AS BIGINT) AS bin, count(*) AS n, CAST(sum(c) AS DOUBLE) AS s, CAST(sum(correct) AS DOUBLE) AS k FROM p GROUP BY CAST(least(floor(c / 2000.0), 9) AS BIGINT))
 SELECT bin, n, floor((s + n) / (2.0 * n)) / 10000.0 AS mean_confidence, floor((20000.0 * k + n) / (2.0 * n)) / 10000.0 AS accuracy, floor((abs(s - 20000.0 * k) + n) / (2.0 * n)) / 10000.0 AS gap FROM b"""
SQL["gate_evaluation"] = """SELECT o_orderpriority AS gate, count(*) AS n, count(*) <= 3000 AS passed, round(sum(CASE WHEN o_orderstatus = 'O' THEN 60 WHEN o_orderstatus = 'P' THEN 30 ELSE 5 END) / 60.0, 2) AS debt_hours
 FROM {orders} GROUP BY o_orderpriority"""
SQL["incident_correlation"] = """WITH e AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS line FROM {events} WHERE event_type = 'error'),
 f AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS line FROM {events} WHERE event_type = 'view')
 SELECT e.event_id AS incident, count(*) AS n, min(abs(e.line - f.line)) AS nearest FROM e JOIN f ON e.user_id = f.user_id AND f.line BETWEEN e.line - 10 AND e.line + 10 GROUP BY e.event_id"""
SQL["tool_quality_full_outer"] = """WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY s_nationkey), c AS (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal > 9000 GROUP BY c_nationkey)
 SELECT coalesce(s.k, c.k) AS tool, coalesce(s.n, 0) AS commits, coalesce(c.n, 0) AS findings, n_name FROM s FULL OUTER JOIN c ON s.k = c.k JOIN {nation} ON n_nationkey = coalesce(s.k, c.k)"""
SQL["pr_risk_components"] = """SELECT score, level, count(*) AS n FROM (SELECT score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS level FROM
 (SELECT least(count(*) * 4, 40) + least(count(DISTINCT o_orderpriority) * 8, 40) + CASE WHEN max(o_totalprice) > 400000 THEN 20 ELSE 0 END AS score FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_custkey) x) y GROUP BY score, level"""
SQL["ml_confidence"] = """SELECT round(conf, 1) AS band, count(*) AS n, CAST(sum(quality) AS BIGINT) AS accepted FROM (SELECT least(greatest(0.4 * least(n_chars / 5000.0, 1.0) + 0.3 * (1 - toxic) + 0.3 * coalesce(nullif(CASE WHEN lang = 'en' THEN 0.9 ELSE 0.0 END, 0.0), 0.5), 0.0), 1.0) AS conf, quality
 FROM {documents} JOIN {labels} USING (doc_id)) x GROUP BY round(conf, 1)"""
SQL["cooccurrence_pairs"] = """WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM {events})
 SELECT a.event_type AS first, b.event_type AS second, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type GROUP BY a.event_type, b.event_type ORDER BY n DESC, first, second LIMIT 5"""
SQL["cascade_transitions"] = """WITH s AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {events})
 SELECT src, dst, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY src), 4) AS p FROM s WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst"""
SQL["beta_posterior"] = """SELECT lang, a + 2 AS alpha, b + 2 AS beta, round((a + 2) * 1.0 / (a + b + 4), 4) AS mean, round((a + 2) * 1.0 * (b + 2) / ((a + b + 4) * 1.0 * (a + b + 4) * (a + b + 5)), 6) AS variance
 FROM (SELECT lang, CAST(sum(quality) AS BIGINT) AS a, CAST(sum(1 - quality) AS BIGINT) AS b FROM {documents} JOIN {labels} USING (doc_id) GROUP BY lang) x"""
SQL["incident_rule_candidates"] = """SELECT user_id, count(*) AS n, round(least(0.5 + 0.1 * (count(*) - 3), 0.95), 4) AS confidence FROM {events}
 WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM {events}) - INTERVAL '7' DAY GROUP BY user_id HAVING count(*) >= 3"""
SQL["stream_error_rate_1h"] = """SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors FROM {events} GROUP BY date_trunc('hour', ts)"""
SQL["stream_sessions_batch"] = """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS opens, event_id FROM {events}),
 s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
 SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM s GROUP BY user_id, sid"""
SQL["audit_page"] = "SELECT event_id, user_id, event_type, count(*) OVER () AS total FROM {events} WHERE event_type = 'error' AND value > 10 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40"
SQL["union_intersect_except"] = """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey AS k FROM {orders} UNION SELECT c_custkey FROM {customer}) a UNION ALL
 SELECT 'intersect', count(*) FROM (SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0) b UNION ALL
 SELECT 'except', count(*) FROM (SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}) c"""
SQL["semi_anti_existence"] = """SELECT c_mktsegment, sum(CASE WHEN o.k IS NOT NULL THEN 1 ELSE 0 END) AS with_runs, sum(CASE WHEN o.k IS NULL THEN 1 ELSE 0 END) AS without_runs
 FROM {customer} LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM {orders}) o ON o.k = c_custkey GROUP BY c_mktsegment"""
SQL["ci_gate"] = """SELECT day, errors, rate <= 0.25 AS rate_ok, errors <= 80 AS count_ok, rate <= 0.25 AND errors <= 80 AS passed FROM
 (SELECT CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS rate FROM {events} GROUP BY CAST(ts AS DATE)) x"""
SQL["provider_selection"] = """SELECT s_nationkey, s_suppkey, round(score, 4) AS score FROM (SELECT s_nationkey, s_suppkey, s_acctbal / (s_suppkey + 0.01) AS score,
 row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal / (s_suppkey + 0.01) DESC, s_suppkey) AS r FROM {supplier} WHERE s_acctbal > 0) x WHERE r = 1"""
SQL["latest_run_per_project"] = """SELECT c_custkey, c_name, o_orderkey AS run_id, o_orderdate AS last_run FROM {customer} LEFT JOIN
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM {orders}) o ON o_custkey = c_custkey AND r = 1"""
SQL["next_run_number"] = "SELECT c_custkey, coalesce(max(n), 0) + 1 AS run_number FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey GROUP BY c_custkey"
SQL["contender_selection"] = """SELECT p_brand, p_partkey, round(score, 4) AS score, score >= 0.5 AS accepted, score >= 0.9 AS auto_apply FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS r FROM
 (SELECT p_brand, p_partkey, 0.4 * p_size / 50.0 + 0.6 * least(p_retailprice / 2000.0, 1.0) AS score FROM {part}) s) x WHERE r = 1"""
SQL["url_lookup_ladder"] = """SELECT page_id, CASE WHEN lower(url) LIKE 'https://%' THEN 1 WHEN lower(url) LIKE 'http://%' THEN 2 ELSE 3 END AS scheme_rank, split_part(split_part(url, '//', 2), '/', 1) AS host,
 CASE WHEN url LIKE '%.html' THEN 'file' WHEN url LIKE '%?%' THEN 'query' ELSE 'path' END AS kind FROM {pages}"""
SQL["message_threads"] = "SELECT conv_id, count(*) AS turns, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS user_turns, max(length(text)) AS longest, min(turn) AS first_turn FROM {conversations} GROUP BY conv_id"
SQL["graph_cycles"] = """WITH t AS (SELECT conv_id, role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM {conversations}), e AS (SELECT DISTINCT src, dst FROM t WHERE dst IS NOT NULL AND src <> dst)
 SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst"""
SQL["debt_rollup"] = """SELECT l_returnflag, l_linestatus, CAST(sum(m) AS BIGINT) AS minutes, count(*) AS n, round(sum(m) / 60.0, 2) AS hours FROM (SELECT l_returnflag, l_linestatus,
 CASE WHEN l_quantity > 45 THEN 120 WHEN l_quantity > 30 THEN 60 WHEN l_quantity > 15 THEN 30 ELSE 15 END AS m FROM {lineitem}) x GROUP BY ROLLUP (l_returnflag, l_linestatus)"""
SQL["coverage_low_files"] = "SELECT o_orderkey, n, covered, round(100.0 * covered / n, 2) AS pct FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS covered FROM {lineitem} GROUP BY l_orderkey) x WHERE covered * 2 < n AND n >= 6"
SQL["share_of_total"] = "SELECT o_orderpriority, o_orderstatus, n, round(n * 100.0 / sum(n) OVER (PARTITION BY o_orderpriority), 4) AS pct FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderpriority, o_orderstatus) x"
SQL["hotspot_patterns"] = "SELECT split_part(url, '/', 3) AS host, count(*) AS n, count(DISTINCT length(url)) AS shapes FROM {pages} GROUP BY split_part(url, '/', 3) ORDER BY n DESC, host LIMIT 10"
SQL["predicted_occurred"] = """SELECT p.user_id, p.event_type, a.user_id IS NOT NULL AS occurred FROM (SELECT DISTINCT user_id, event_type FROM {events} WHERE value > 95) p LEFT JOIN
 (SELECT DISTINCT user_id, event_type FROM {events} WHERE value < 5) a ON a.user_id = p.user_id AND a.event_type = p.event_type"""
SQL["health_score"] = "SELECT user_id, greatest(0, 100 - 15 * sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) - 3 * sum(CASE WHEN value BETWEEN 50 AND 60 THEN 1 ELSE 0 END)) AS score FROM {events} WHERE event_type = 'error' GROUP BY user_id"
# ---- over lines and findings
SQL["doc_metrics"] = "SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN trim(txt) = '' THEN 1 ELSE 0 END) AS blank, max(length(txt)) AS longest, sum(CASE WHEN length(txt) > 140 THEN 1 ELSE 0 END) AS long_lines FROM {lines} GROUP BY doc_id"
SQL["long_line_top3"] = "SELECT doc_id, line, length(txt) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r FROM {lines} WHERE length(txt) > 140) x WHERE r <= 3"
SQL["scan_text_rules"] = "SELECT doc_id, line, rule_id, severity, impact, domain, col, end_col FROM {findings}"
SQL["severity_summary"] = "SELECT severity, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(CASE severity WHEN 'CRITICAL' THEN 10.0 WHEN 'HIGH' THEN 5.0 WHEN 'MEDIUM' THEN 2.0 ELSE 0.5 END) AS penalty FROM {findings} GROUP BY severity"
SQL["findings_by_document"] = "SELECT doc_id, count(*) AS n, count(DISTINCT rule_id) AS rules, max(impact) AS worst, min(line) AS first_line FROM {findings} GROUP BY doc_id"
SQL["rule_stats"] = "SELECT rule_id, severity, count(*) AS n, round(avg(impact), 4) AS impact, max(col) AS furthest FROM {findings} GROUP BY rule_id, severity"
SQL["scan_html_rules"] = "SELECT doc_id AS page_id, line, rule_id, severity, col FROM {html_findings}"
SQL["cloned_lines"] = "SELECT n, n_docs, count(*) AS classes FROM (SELECT lower(trim(txt)) AS body, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM {lines} WHERE length(trim(txt)) >= 40 GROUP BY lower(trim(txt)) HAVING count(*) > 1) x GROUP BY n, n_docs"
SQL["benchmark_contamination"] = "SELECT b.item_id, count(d.doc_id) AS n, min(d.doc_id) AS first_doc FROM {benchmark} b LEFT JOIN {lines} d ON trim(d.txt) = trim(b.text) GROUP BY b.item_id"
SQL["grep_search"] = "SELECT doc_id, line, position('token' IN lower(txt)) AS col, substr(txt, 1, 240) AS preview FROM {lines} WHERE contains(lower(txt), 'token')"


def _closing(sql: str, at: int) -> int:
    """The place behind the bracket that closes the one before ``at``."""
    depth = 1
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[at], 0)
        at += 1
    return at


def plain_numbers(sql: str) -> str:
    """Literals with a point as doubles, and sums of whole-number cases as BIGINT, so that both engines give the same types."""
    import re

    sql = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)
    at = 0
    while (at := sql.find("sum(CASE", at)) >= 0:
        end = _closing(sql, at + 4)
        inner = sql[at + 4 : end - 1]
        if over := re.match(r" OVER (\(|\w+)", sql[end:]):
            end = _closing(sql, end + over.end()) if over[1] == "(" else end + over.end()
        if re.fullmatch(r".* THEN \d+( ELSE \d+)? END", inner) and "e0" not in inner:
            call = f"CAST({sql[at:end]} AS BIGINT)"
            sql = sql[:at] + call + sql[end:]
            at += len("CAST(sum(")
        else:
            at += 4
    return sql


def duck(sql: str) -> str:
    """The query for DuckDB, with the operators' tables as common table expressions."""
    ctes = []
    if "{lines}" in sql or "{findings}" in sql:
        ctes.append("lines AS (SELECT doc_id, lang, CAST(i AS BIGINT) AS line, parts[i] AS txt, length(text) <= 500000 AND len(parts) <= 5000 AS scanned FROM (SELECT doc_id, lang, text, regexp_split_to_array(text, '\\r?\\n') AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS r(i))")
    if "{html_findings}" in sql:
        from ..operators.scan import HTML_RULES

        ctes.append("hl AS (SELECT page_id AS doc_id, CAST(i AS BIGINT) AS line, parts[i] AS txt FROM (SELECT page_id, regexp_split_to_array(html, '\\r?\\n') AS parts FROM pages), unnest(range(1, len(parts) + 1)) AS r(i))")
        ctes.append(f"html_findings AS ({_rule_union(HTML_RULES, 'hl')})")
    if "{findings}" in sql:
        ctes.append(f"findings AS ({_rule_union(TEXT_RULES, '(SELECT * FROM lines WHERE scanned)')})")
    body = sql
    for name in ("lines", "findings", "html_findings"):
        body = body.replace("{" + name + "}", name)
    import re

    body = re.sub(r"\{(\w+)\}", r"\1", body)
    if not ctes:
        return body
    head, _, rest = body.lstrip().partition("WITH ") if body.lstrip().startswith("WITH ") else ("", "", "")
    return f"WITH {', '.join(ctes)}, {rest}" if rest else f"WITH {', '.join(ctes)} {body}"


def _rule_union(rules, source: str) -> str:
    def place(r) -> str:
        before = f"length(regexp_extract(txt, '^(.*?)(?:{r.pattern})', 1))"
        return f"{before} + length(regexp_extract(txt, '{r.pattern}', 1))" if r.led else before

    return " UNION ALL ".join(
        f"SELECT doc_id, line, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, CAST({r.impact} AS BIGINT) AS impact, '{r.domain}' AS domain, '{r.message}' AS message, CAST({place(r)} AS BIGINT) AS col,"
        f" CAST({place(r)} + length(regexp_extract(txt, '{r.pattern}', {2 if r.led else 0})) AS BIGINT) AS end_col FROM {source} WHERE regexp_matches(txt, '{r.pattern}')"
        for r in rules
    )
