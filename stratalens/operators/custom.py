"""Custom rules with regions: patterns, alternatives, exclusions at the same place, and regions that must hold a match.

A rule gives findings where one of its patterns matches (``either``), not where an excluded pattern matches at the
same line and column, only inside a match of ``inside`` where it has one, and not on comment lines.  Matches and
regions are intervals of character places in a file; which matches lie in a region is found by one sweep over the
ends of both, and never by comparing all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import metavariable_regex


@dataclass(frozen=True)
class CustomRule:
    """Patterns may hold metavariables ($X); ``{X}`` in ``message`` and ``fix`` stands for what the first one took."""

    rule_id: str
    severity: str
    either: tuple[str, ...]
    inside: str = ""
    excluded: tuple[str, ...] = ()
    langs: tuple[str, ...] = ("*",)
    message: str = ""
    fix: str = ""

    def problems(self) -> list[str]:
        """What is wrong with the rule; empty for a good one."""
        out = [] if self.rule_id else ["no rule_id"]
        out += [] if self.either else ["no pattern"]
        return out + ([] if self.severity in ("CRITICAL", "HIGH", "MEDIUM", "LOW") else [f"severity {self.severity}"])


def intervals(files: DataFrame, pattern: str, file: str = "file", text: str = "content") -> DataFrame:
    """file, start, stop (characters from 0, stop exclusive), match: all matches of an expression, left to right."""
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    both = files.where(F.col(text).isNotNull()).select(F.col(file).alias("file"), hits.alias("hits"), between.alias("between")).where(F.size("hits") > 0)
    each = both.select("file", F.posexplode(F.arrays_zip("hits", F.slice("between", F.lit(1), F.size("hits")).alias("before"))).alias("k", "x"))
    w = Window.partitionBy("file").orderBy("k")
    n = F.length("x.hits")
    stop = F.sum(n + F.length("x.before")).over(w)
    return each.select("file", (stop - n).cast("long").alias("start"), stop.cast("long").alias("stop"), F.col("x.hits").alias("match"))


def contained(matches: DataFrame, regions: DataFrame) -> DataFrame:
    """The matches that lie in a region of the same file, by a sweep: of the regions that begin before, the one that reaches furthest decides."""
    ends = regions.select("file", F.col("start").alias("_at"), F.col("stop").alias("_reach"), F.lit(0).alias("_kind"))
    both = ends.unionByName(matches.withColumn("_at", F.col("start")).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("file").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_far", F.max("_reach").over(w)).where((F.col("_kind") == 1) & (F.col("_far") >= F.col("stop"))).select(*matches.columns)


def _comment_line(text: Column, start: Column) -> Column:
    head = F.substring_index(F.substr(text, F.lit(1), start), "\n", -1)
    return head.rlike(r"^\s*(//|#|\*|/\*)")


def run_rule(files: DataFrame, rule: CustomRule, file: str = "file", text: str = "content", lang: str | None = None) -> DataFrame:
    """file, line, col, rule_id, severity, match, message, fix: the findings of one rule, once for each place.

    ``col`` counts from 0.  Null texts give nothing.
    """
    if rule.problems():
        raise ValueError("; ".join(rule.problems()))
    wanted = files.where(F.col(lang).isin(*rule.langs)) if lang and "*" not in rule.langs else files
    src = wanted.select(F.col(file).alias("file"), F.col(text).alias("content"))
    names = reduce(lambda a, b: a + [x for x in b if x not in a], ([w[1:] for w in p.replace("(", " ").replace(")", " ").replace('"', " ").split() if w.startswith("$")] for p in rule.either), [])
    found = reduce(DataFrame.unionByName, [intervals(src, metavariable_regex(p)).withColumn("value", F.regexp_extract("match", metavariable_regex(p), 1) if "$" in p else F.lit("")) for p in rule.either])
    found = found.groupBy("file", "start").agg(F.max_by(F.struct("stop", "match", "value"), F.struct("stop", "match")).alias("m")).select("file", "start", "m.*")
    for p in rule.excluded:
        found = found.join(intervals(src, metavariable_regex(p)).select("file", "start").distinct(), ["file", "start"], "left_anti")
    if rule.inside:
        found = contained(found, intervals(src, rule.inside))
    placed = found.join(src, "file")
    before = F.substr("content", F.lit(1), F.col("start"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    col = F.length(F.substring_index(before, "\n", -1))
    told = lambda t: F.replace(F.lit(t), F.lit("{" + names[0] + "}"), F.col("value")) if names else F.lit(t)
    kept = placed.where(~_comment_line(F.col("content"), F.col("start")))
    return kept.select("file", line.cast("long").alias("line"), col.cast("long").alias("col"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), "match", told(rule.message).alias("message"), told(rule.fix).alias("fix"))


def run_rules(files: DataFrame, rules: tuple[CustomRule, ...], file: str = "file", text: str = "content", lang: str | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [run_rule(files, r, file, text, lang) for r in rules])


# ---- the same for DuckDB


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _intervals_sql(pattern: str) -> str:
    return (
        f"SELECT file, CAST(sum(length(m[k]) + length(b[k])) OVER (PARTITION BY file ORDER BY k) - length(m[k]) AS BIGINT) AS start, CAST(sum(length(m[k]) + length(b[k])) OVER (PARTITION BY file ORDER BY k) AS BIGINT) AS stop, m[k] AS match"
        f" FROM (SELECT file, regexp_extract_all(content, {_q(pattern)}) AS m, regexp_split_to_array(content, {_q(pattern)}) AS b FROM src), unnest(range(1, len(m) + 1)) AS t(k)"
    )


def rule_sql(files: str, rule: CustomRule) -> str:
    """The findings of a rule on a relation (file, content); regions are compared as intervals."""
    each = " UNION ALL ".join(f"SELECT *, {f'regexp_extract(match, {_q(metavariable_regex(p))}, 1)' if '$' in p else _q('')} AS value FROM ({_intervals_sql(metavariable_regex(p))})" for p in rule.either)
    names = [w[1:] for p in rule.either for w in p.replace("(", " ").replace(")", " ").replace('"', " ").split() if w.startswith("$")]
    told = lambda t: f"replace({_q(t)}, {_q('{' + names[0] + '}')}, value)" if names else _q(t)
    tests = [f"NOT EXISTS (SELECT 1 FROM ({_intervals_sql(metavariable_regex(p))}) x WHERE x.file = f.file AND x.start = f.start)" for p in rule.excluded]
    tests += [f"EXISTS (SELECT 1 FROM ({_intervals_sql(rule.inside)}) x WHERE x.file = f.file AND x.start <= f.start AND x.stop >= f.stop)"] if rule.inside else []
    tests += ["NOT regexp_matches(string_split(substr(content, 1, start), chr(10))[-1], '^\\s*(//|#|\\*|/\\*)')"]
    return (
        f"WITH src AS (SELECT file, content FROM ({files}) WHERE content IS NOT NULL), a AS ({each}), f AS (SELECT file, start, stop, match, value FROM a QUALIFY row_number() OVER (PARTITION BY file, start ORDER BY stop DESC, match DESC) = 1)"
        f" SELECT f.file, CAST(length(substr(content, 1, start)) - length(replace(substr(content, 1, start), chr(10), '')) + 1 AS BIGINT) AS line, CAST(length(string_split(substr(content, 1, start), chr(10))[-1]) AS BIGINT) AS col,"
        f" {_q(rule.rule_id)} AS rule_id, {_q(rule.severity)} AS severity, match, {told(rule.message)} AS message, {told(rule.fix)} AS fix FROM f JOIN src USING (file) WHERE {' AND '.join(tests)}"
    )
