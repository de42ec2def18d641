"""Further relational queries, in the same form as the catalogue's."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["fixes_map_merge"] = "SELECT category, CAST(sum(n) AS BIGINT) AS fixes, round(100.0 * sum(n) / sum(sum(n)) OVER (), 4) AS rate FROM (SELECT o_orderpriority AS category, count(*) AS n FROM {orders} GROUP BY o_orderpriority UNION ALL SELECT l_shipmode, n FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n FROM {lineitem} GROUP BY l_returnflag) x) y GROUP BY category"
SQL["maintainability_index"] = "SELECT doc_id, round(greatest(0, 100 - least(n * 0.05, 30) - least(long_n * 5.0, 40) - CASE WHEN widest > 200 THEN 10 ELSE 0 END), 4) AS idx FROM (SELECT doc_id, count(*) AS n, sum(CASE WHEN length(txt) > 140 THEN 1 ELSE 0 END) AS long_n, max(length(txt)) AS widest FROM {lines} GROUP BY doc_id) x"
SQL["pr_score_by_tool"] = "SELECT doc_id, least(70, 4 * sum(CASE severity WHEN 'CRITICAL' THEN 8 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 3 ELSE 1 END)) + CASE WHEN count(*) > 5 THEN 5 WHEN count(*) > 2 THEN 3 ELSE 0 END AS score FROM {findings} GROUP BY doc_id"
SQL["fix_verification_consensus"] = "SELECT user_id, n, round(agree, 4) AS agree, CASE WHEN n < 2 THEN 'review' WHEN agree >= 0.9 THEN 'apply' WHEN agree >= 0.7 THEN 'suggest' WHEN agree >= 0.5 THEN 'review' ELSE 'reject' END AS action FROM (SELECT user_id, count(*) AS n, avg(CASE WHEN value < 60 THEN 1.0 ELSE 0.0 END) AS agree FROM {events} GROUP BY user_id) x"
SQL["remediation_vote"] = "SELECT event_type, count(*) AS n, round(sum(w) / sum(sum(w)) OVER (), 4) AS share, round(avg(value), 4) AS mean_similarity FROM (SELECT event_type, value, value * coalesce(nullif(user_id % 3, 0), 0.5) AS w FROM {events}) x GROUP BY event_type"
SQL["incident_clusters"] = "SELECT event_type, user_id % 10 AS file_pattern, count(*) AS n, round(least(0.5 + 0.05 * (count(*) - 1), 0.95), 4) AS confidence, max(value) > 99 AS any_critical FROM {events} WHERE event_type IN ('error', 'purchase') GROUP BY event_type, user_id % 10 HAVING count(*) >= 3"
SQL["tool_attribution"] = "SELECT s_nationkey AS tool, count(*) AS n, round(avg(s_acctbal), 2) AS mean, round(100.0 * sum(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END) / count(*), 4) AS coverage FROM {supplier} GROUP BY s_nationkey"
SQL["memory_preference"] = "SELECT event_type, round(sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END), 2) AS accepted, round(sum(CASE WHEN user_id % 2 = 1 THEN value ELSE 0 END), 2) AS rejected, sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) > sum(CASE WHEN user_id % 2 = 1 THEN value ELSE 0 END) AS prefers FROM {events} GROUP BY event_type"
SQL["visual_risk"] = "SELECT doc_id, least(100, sum(CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 10 ELSE 2 END)) AS risk FROM {findings} GROUP BY doc_id"
SQL["dx_score"] = "SELECT user_id, round(0.4 * a + 0.3 * b + 0.3 * c, 4) AS dx FROM (SELECT user_id, avg(value) AS a, avg(CASE WHEN event_type = 'view' THEN 100.0 ELSE 0.0 END) AS b, 100.0 - avg(CASE WHEN event_type = 'error' THEN 100.0 ELSE 0.0 END) AS c FROM {events} GROUP BY user_id) x"
SQL["accuracy_gate"] = "SELECT lang, n, round(acc, 4) AS accuracy, CASE WHEN n < 10 THEN 'warn' WHEN acc >= 0.85 THEN 'pass' WHEN acc >= 0.80 THEN 'warn' ELSE 'fail' END AS verdict FROM (SELECT lang, count(*) AS n, avg(CASE WHEN (n_chars >= 400) = (quality = 1) THEN 1.0 ELSE 0.0 END) AS acc FROM {documents} JOIN {labels} USING (doc_id) GROUP BY lang) x"
SQL["brace_depth"] = "SELECT doc_id, CAST(max(depth) AS BIGINT) AS deepest, CAST(min(depth) AS BIGINT) AS lowest FROM (SELECT doc_id, sum(length(txt) - length(replace(txt, '(', '')) - length(txt) + length(replace(txt, ')', ''))) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM {lines}) x GROUP BY doc_id"
SQL["tool_ranking"] = "SELECT s_nationkey AS tool, n, rank() OVER (ORDER BY n DESC) AS place, dense_rank() OVER (ORDER BY n DESC) AS dense FROM (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY s_nationkey) x"
SQL["sliding_blocks"] = "SELECT doc_id, line, filled FROM (SELECT doc_id, line, sum(CASE WHEN trim(txt) <> '' THEN 1 ELSE 0 END) OVER w AS filled, count(*) OVER w AS n FROM {lines} WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) x WHERE n = 5 AND filled >= 3"
SQL["debt_contributors"] = "SELECT l_suppkey, minutes, round(100.0 * minutes / sum(minutes) OVER (), 4) AS pct FROM (SELECT l_suppkey, sum(CASE WHEN l_quantity > 45 THEN 120 ELSE 15 END) AS minutes FROM {lineitem} GROUP BY l_suppkey) x ORDER BY minutes DESC, l_suppkey LIMIT 10"
SQL["improvement_priority"] = "SELECT p_partkey, round(0.5 * (p_size % 10) + 0.3 * (10 - p_size / 5.0) + 0.2 * (10 - p_retailprice / 250.0), 4) AS priority FROM {part} ORDER BY 0.5 * (p_size % 10) + 0.3 * (10 - p_size / 5.0) + 0.2 * (10 - p_retailprice / 250.0) DESC, p_partkey LIMIT 20"
SQL["agent_least_loaded"] = "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(n, 0), c_custkey) AS r FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey) x WHERE r = 1"
SQL["dismissal_suppression"] = "SELECT f.doc_id, f.line, f.rule_id FROM {findings} f LEFT JOIN (SELECT rule_id, doc_id % 10 AS k FROM {findings} GROUP BY rule_id, doc_id % 10 HAVING count(*) >= 3) s ON s.rule_id = f.rule_id AND s.k = f.doc_id % 10 WHERE s.rule_id IS NULL"
SQL["false_positive_split"] = "SELECT f.doc_id, f.line, f.rule_id, CASE WHEN f.severity IN ('CRITICAL', 'HIGH') THEN 'review' ELSE 'pass' END AS route FROM {findings} f LEFT JOIN {labels} l ON l.doc_id = f.doc_id WHERE coalesce(l.toxic, 0) = 0"
SQL["dependency_reachability"] = "SELECT p_partkey, CASE WHEN n IS NULL THEN 'LOW' WHEN returned > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS risk, coalesce(returned, 0) > 0 AS reachable FROM {part} LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM {lineitem} GROUP BY l_partkey) l ON l_partkey = p_partkey"
SQL["vulnerability_join"] = "SELECT p_brand, count(*) AS packages, count(DISTINCT CASE WHEN l_partkey IS NOT NULL THEN p_partkey END) AS vulnerable FROM {part} LEFT JOIN (SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_discount >= 0.1) v ON l_partkey = p_partkey GROUP BY p_brand"
SQL["score_to_test_match"] = "SELECT e.event_id, c.conv_id, count(*) OVER (PARTITION BY e.event_id) AS candidates FROM {events} e JOIN (SELECT DISTINCT conv_id FROM {conversations}) c ON c.conv_id = e.user_id"
SQL["ttl_cache_validity"] = "SELECT user_id, max(ts) >= (SELECT max(ts) FROM {events}) - INTERVAL '24' HOUR AS valid, count(*) AS n FROM {events} GROUP BY user_id"
SQL["unresolved_critical"] = "SELECT user_id, count(*) AS n FROM {events} e WHERE event_type = 'error' AND value > 80 AND NOT EXISTS (SELECT 1 FROM {events} r WHERE r.user_id = e.user_id AND r.event_type = 'purchase' AND r.ts > e.ts) GROUP BY user_id"
SQL["progress_eta"] = "SELECT event_type, done, total, round(100.0 * done / total, 2) AS pct FROM (SELECT event_type, sum(CASE WHEN value < 70 THEN 1 ELSE 0 END) AS done, count(*) AS total FROM {events} GROUP BY event_type) x"
SQL["path_functions"] = "SELECT page_id, split_part(url, '/', 3) AS host, CASE WHEN url LIKE '%.html' THEN '.html' ELSE '' END AS ext, lower(split_part(url, ':', 1)) AS scheme FROM {pages}"
SQL["fix_risk_lattice"] = "SELECT doc_id, CASE WHEN contains(lower(text), 'token') THEN 'HIGH' WHEN n_chars > 5000 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM {documents}"
SQL["document_quality_score"] = "SELECT doc_id, round(least(greatest(1 - least(longest / 5000.0, 0.4) - CASE WHEN n < 3 THEN 0.2 ELSE 0.0 END, 0), 1), 4) AS score FROM (SELECT doc_id, max(length(txt)) AS longest, count(*) AS n FROM {lines} GROUP BY doc_id) x"
SQL["confidence_trend_30"] = "SELECT day, n, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS mean7 FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM {events} GROUP BY CAST(ts AS DATE)) x ORDER BY day LIMIT 30"
SQL["grouping_sets_by_rule"] = "SELECT rule_id, severity, count(*) AS n FROM {findings} GROUP BY GROUPING SETS ((rule_id), (severity), ())"
SQL["first_finding_per_file"] = "SELECT doc_id, line, rule_id FROM (SELECT doc_id, line, rule_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, col, rule_id) AS r FROM {findings}) x WHERE r = 1"
SQL["symmetric_difference"] = "(SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}) UNION ALL (SELECT doc_id FROM {labels} EXCEPT SELECT doc_id FROM {documents})"
