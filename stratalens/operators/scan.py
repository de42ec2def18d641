"""Rule scans: a rule table becomes one array of conditions per line, so any number of rules is one pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import metavariable_regex, shannon_entropy
from ..sources.text import MAX_CHARS, MAX_LINES, lines


@dataclass(frozen=True)
class Rule:
    """A line rule.  ``pattern`` is searched in each line; guards are further conditions."""

    rule_id: str
    severity: str
    impact: int
    pattern: str
    message: str = ""
    domain: str = "security"
    cwe: str = ""
    langs: tuple[str, ...] = ()
    file_requires: str = ""
    file_guard: str = ""
    line_guard: str = ""
    pattern_not: str = ""
    tags: tuple[str, ...] = ()
    enabled: bool = True
    #: Whether group 1 of the pattern is what stands before the match, and group 2 the match.
    led: bool = False


#: Rules for prose and mark-up, in the subset of expressions that all engines share.
TEXT_RULES = (
    Rule("GENERIC_SECRET", "CRITICAL", 10, r"[Tt][Oo][Kk][Ee][Nn] *= *.[0-9a-fA-F]{40}", "Secret in text", cwe="CWE-798"),
    Rule("EMAIL_ADDRESS", "MEDIUM", 5, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "E-mail address", "privacy"),
    Rule("IPV4_ADDRESS", "MEDIUM", 4, r"(^|[^0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?:[^0-9.]|$)", "Network address", "privacy", led=True),
    Rule("CARD_NUMBER", "HIGH", 8, r"(^|[^0-9])([0-9]{16})(?:[^0-9]|$)", "Card-like number", "privacy", led=True),
    Rule("LICENSE_LINE", "LOW", 2, r"[Ll]icensed under|MIT License|General Public License|All rights reserved", "Licence text", "legal"),
    Rule("LONG_LINE", "LOW", 3, r"^.{141}", "Line above 140 characters", "refactoring"),
    Rule("BIDI_CONTROL", "HIGH", 9, "[‪-‮⁦-⁩]", "Bidirectional control character"),
)
HTML_RULES = (
    Rule("INLINE_SCRIPT", "MEDIUM", 5, r"<script>", "Inline script"),
    Rule("JS_URL", "HIGH", 8, r"href=.javascript:", "Script address"),
    Rule("EVENT_HANDLER", "MEDIUM", 6, r" on(click|load|error)=", "Inline handler"),
    Rule("PLAIN_HTTP", "LOW", 2, r"(href|src)=.http://", "Unencrypted link"),
    Rule("IFRAME", "LOW", 3, r"<iframe", "Frame"),
)
#: Severity order for thresholds.
ORDER = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def select_rules(rules: tuple[Rule, ...], lang: str | None = None, min_severity: str = "INFO", tags: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Enabled rules for a language (or all), at a severity or above, that share a tag if tags are given."""
    return tuple(r for r in rules if r.enabled and (not r.langs or lang is None or lang in r.langs or "*" in r.langs) and ORDER[r.severity] >= ORDER[min_severity] and (not tags or set(tags) & set(r.tags)))


def custom_rule(rule_id: str, pattern: str, severity: str = "MEDIUM", **more) -> Rule:
    """A rule from a code pattern with metavariables."""
    return Rule(rule_id, severity, more.pop("impact", 5), metavariable_regex(pattern), **more)


def _place(txt: Column, r: Rule) -> Column:
    """Where the first match of a rule begins in its line, from 0."""
    before = F.length(F.regexp_extract(txt, f"^(.*?)(?:{r.pattern})", 1))
    return (before + F.length(F.regexp_extract(txt, r.pattern, 1)) if r.led else before).cast("long")


def scan(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", path: str | None = None, lang: str | None = None, guard: bool = False) -> DataFrame:
    """Findings of all rules: the columns of ``docs`` but the text, line, rule_id, severity, impact, domain, message, col, end_col, match, snippet.

    One projection holds all rules of a line; document guards are computed on the document row before
    lines are made, so the text is read once.  Columns are 0-based starts of the first match.  With
    ``guard`` oversize documents give none.
    """
    rules = tuple(r for r in rules if r.enabled)
    flags = []
    for i, r in enumerate(rules):
        ok = F.lit(True)
        if r.file_requires:
            ok = ok & F.col(text).rlike(r.file_requires)
        if r.file_guard and path:
            ok = ok & ~F.col(path).rlike(r.file_guard)
        if r.langs and lang and "*" not in r.langs:
            ok = ok & F.col(lang).isin(*r.langs)
        if r.file_requires or (r.file_guard and path) or (r.langs and lang):
            docs = docs.withColumn(f"_g{i}", ok)
            flags.append(i)
    txt = F.col("txt")
    conditions = []
    for i, r in enumerate(rules):
        hit = txt.rlike(r.pattern)
        if r.pattern_not:
            hit = hit & ~txt.rlike(r.pattern_not)
        if r.line_guard:
            hit = hit & ~txt.rlike(r.line_guard)
        if i in flags:
            hit = F.col(f"_g{i}") & hit
        conditions.append(F.when(hit, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.impact).cast("long").alias("impact"), F.lit(r.domain).alias("domain"), F.lit(r.message).alias("message"), F.regexp_extract(txt, r.pattern, 2 if r.led else 0).alias("match"), _place(txt, r).alias("col"))))
    rows = lines(docs, text, guard)
    keep = [c for c in docs.columns if c != text and not c.startswith("_g")]
    each = rows.select(*keep, "line", "txt", F.explode(F.filter(F.array(*conditions), lambda x: x.isNotNull())).alias("f"))
    return each.select(*keep, "line", "f.rule_id", "f.severity", "f.impact", "f.domain", "f.message", "f.col", (F.col("f.col") + F.length("f.match")).alias("end_col"), F.col("f.match").alias("match"), F.substring("txt", 1, 160).alias("snippet"))


def with_suppressions(rows: DataFrame, key: str = "doc_id", marker: str = "allow-next-line") -> DataFrame:
    """Lines with ``suppressed``: the line before carries the marker."""
    w = Window.partitionBy(key).orderBy("line")
    return rows.withColumn("suppressed", F.coalesce(F.contains(F.lag("txt").over(w), F.lit(marker)), F.lit(False)))


def with_context(rows: DataFrame, key: str = "doc_id", around: int = 2) -> DataFrame:
    """Lines with ``context``, the lines around them in order."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(-around, around)
    return rows.withColumn("context", F.array_join(F.collect_list("txt").over(w), "\n"))


def coverage(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lines_analyzed, skipped: what the guarded rule scan reads of each document; oversize ones count no lines."""
    n = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    read = (F.length(text) <= MAX_CHARS) & (n <= MAX_LINES)
    return docs.select("doc_id", F.when(read, n).otherwise(F.lit(0)).cast("long").alias("lines_analyzed"), (~read).alias("skipped"))


def complexity(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, ifs, loops, functions, tries, complexity (tries count twice) and its level, by whole words."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    c = docs.select("doc_id", count(r"\bif\b").alias("ifs"), count(r"\b(?:for|while)\b").alias("loops"), count(r"\bfunction\b|=>").alias("functions"), count(r"\b(?:try|catch)\b").alias("tries"))
    c = c.withColumn("complexity", F.col("ifs") + F.col("loops") + F.col("functions") + 2 * F.col("tries"))
    return c.withColumn("level", F.when(F.col("complexity") < 10, "low").when(F.col("complexity") < 30, "medium").otherwise("high"))


def high_entropy_tokens(docs: DataFrame, text: str = "text", least: int = 20, bits: float = 4.5) -> DataFrame:
    """doc_id, token, entropy of quoted runs of ``least`` characters or more without blanks above ``bits``.

    Addresses and runs with over a fifth of characters outside ASCII are prose.  Runs of any length are judged.
    """
    t = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f'"([^"\\s]{{{least},}})"'), F.lit(1)))).alias("token"))
    foreign = F.length(F.regexp_replace("token", r"[\x20-\x7e]", ""))
    t = t.where(~F.col("token").rlike(r"^https?://") & (foreign * 5 <= F.length("token")))
    return t.withColumn("entropy", F.round(shannon_entropy("token"), 4)).where(F.col("entropy") > bits)


def first_secret_per_rule(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """doc_id, line, rule_id: in document order, one finding per rule and document and one rule per line, earlier rules first.

    A line that one rule has taken is closed to the others, so a document is read as a state machine.
    """
    import re

    compiled = [(r.rule_id, re.compile(r.pattern)) for r in rules if r.enabled]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, t in zip(b["doc_id"], b[text], strict=True):
                done: set[str] = set()
                for n, line in enumerate(re.split("\r?\n", t or ""), 1):
                    for rule_id, p in compiled:
                        if rule_id not in done and p.search(line):
                            done.add(rule_id)
                            out.append((doc, n, rule_id))
                            break
            yield pd.DataFrame(out, columns=["doc_id", "line", "rule_id"])

    return docs.select("doc_id", text).mapInPandas(run, "doc_id long, line long, rule_id string")


def taint(docs: DataFrame, text: str = "text", sources: str = r"\b(?:req|request)\.(?:body|query|params|headers)\b|\binput\(", sinks: str = r"\b(?:eval|exec|query|execute|system)\s*\(", sanitizers: str = r"\b(?:escape|sanitize|validate|parseInt)\w*\(", rounds: int = 5, back: int = 5) -> DataFrame:
    """doc_id, line, variable: sinks that a tainted name reaches, one per line.

    Names assigned from a source are tainted; up to ``rounds`` passes carry taint over assignments; a
    sanitizer on the line or ``back`` lines before clears the finding.
    """
    import re

    src, snk, san = re.compile(sources), re.compile(sinks), re.compile(sanitizers)
    assign = re.compile(r"(?:const|let|var)?\s*(?:\{([^}]*)\}|([A-Za-z_$][\w$]*))\s*=(?!=)\s*(.+)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, t in zip(b["doc_id"], b[text], strict=True):
                rows, dirty = re.split("\r?\n", t or ""), set()
                steps = [(re.findall(r"[\w$]+", m[1] or m[2]), m[3]) for m in map(assign.match, map(str.strip, rows)) if m]
                for _ in range(rounds):
                    before = len(dirty)
                    for names, value in steps:
                        if src.search(value) or any(re.search(rf"(?<![\w$]){re.escape(v)}(?![\w$])", value) for v in dirty):
                            dirty.update(names)
                    if len(dirty) == before:
                        break
                for n, line in enumerate(rows, 1):
                    m = snk.search(line)
                    if not m or any(san.search(x) for x in rows[max(0, n - 1 - back) : n]):
                        continue
                    args = line[m.end() :]
                    hit = next((v for v in sorted(dirty) if re.search(rf"(?<![\w$]){re.escape(v)}(?![\w$])", args)), None) or (src.search(args) and src.search(args)[0])
                    if hit:
                        out.append((doc, n, hit))
            yield pd.DataFrame(out, columns=["doc_id", "line", "variable"])

    return docs.select("doc_id", text).mapInPandas(run, "doc_id long, line long, variable string")
