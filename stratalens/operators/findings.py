"""Findings: deduplication, priorities, summaries, gates, baselines, votes, debt, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DEBT_MINUTES, PENALTY, PRIORITY, by_severity, clamp, grade

KEY = ("doc_id", "line", "rule_id")


def deduplicate(findings: DataFrame, key: tuple[str, ...] = KEY, first_by: tuple[str, ...] = ("col",)) -> DataFrame:
    """The first finding of each key."""
    w = Window.partitionBy(*key).orderBy(*first_by)
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prioritise(findings: DataFrame) -> DataFrame:
    """Adds ``priority``: severity weight times impact (null or 0 counts as 1); unknown severities weigh 0."""
    impact = F.when(F.coalesce("impact", F.lit(0)) == 0, 1).otherwise(F.col("impact"))
    return findings.withColumn("priority", (by_severity("severity", PRIORITY, 0) * impact).cast("long"))


def top(findings: DataFrame, n: int = 10, tie: tuple[str, ...] = KEY) -> DataFrame:
    """The ``n`` findings of highest priority; ties by the key."""
    return findings.orderBy(F.desc("priority"), *tie).limit(n)


def summary(findings: DataFrame, documents: DataFrame, n_lines: Column) -> DataFrame:
    """One row: counts by severity, documents with findings, lines, issues per thousand lines, score and grade."""
    size = documents.agg(F.sum(n_lines).cast("long").alias("n_lines"))
    s = findings.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("severity") == x).alias(x.lower()) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        F.countDistinct("doc_id").alias("n_docs"), F.coalesce(F.sum(by_severity("severity", PENALTY, 0.0)), F.lit(0.0)).alias("penalty"),
    )
    out = s.join(size)  # one row each
    per_kloc = F.when(F.col("n_lines") > 0, F.round(1000.0 * F.col("total") / F.col("n_lines"), 4)).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), 100.0 - F.col("penalty"))
    return out.withColumn("per_kloc", per_kloc).withColumn("score", score).withColumn("grade", grade("score"))


def domain_summary(findings: DataFrame, domains: DataFrame) -> DataFrame:
    """domain, n, n_docs for every domain of the dimension table, zeros included."""
    counts = findings.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    return domains.join(counts, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def new_since(findings: DataFrame, baseline: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Findings that the baseline does not hold; null keys equal each other."""
    b = baseline.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    on = None
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = c if on is None else on & c
    return findings.join(b, on, "left_anti")


def merge_with_tolerance(first: DataFrame, second: DataFrame, keys: tuple[str, ...], at: str, within: int) -> DataFrame:
    """All of ``first`` and the rows of ``second`` that no row of ``first`` with equal keys is near.

    Buckets of ``within + 1`` positions and their neighbours make it an equi-join.
    """
    size = within + 1
    f = first.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(at).alias("_at"), F.explode(F.array(*[F.floor(F.col(at) / size) + d for d in (-1, 0, 1)])).alias("_b"))
    s = second.withColumn("_b2", F.floor(F.col(at) / size))
    on = (F.col("_b2") == F.col("_b")) & (F.abs(F.col(at) - F.col("_at")) <= within)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return first.unionByName(s.join(f, on, "left_anti").drop("_b2"))


def run_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, status: added, fixed or unchanged."""
    a, b = before.select(key).distinct().withColumn("_a", F.lit(1)), after.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "fixed").otherwise("unchanged").alias("status"))


def debt(findings: DataFrame, by: str) -> DataFrame:
    """Minutes of debt per group and in all (null group), with hours."""
    m = findings.withColumn("minutes", by_severity("severity", DEBT_MINUTES, 10).cast("long"))
    return m.rollup(by).agg(F.sum("minutes").alias("minutes"), F.count("*").alias("n")).withColumn("hours", F.round(F.col("minutes") / 60.0, 2))


def quality_gates(findings: DataFrame, limits: dict[str, int]) -> DataFrame:
    """gate, value, limit_value, passed for the largest allowed count of each severity."""
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in limits])
    rows = F.array(*[F.struct(F.lit(s).alias("gate"), F.col(s).alias("value"), F.lit(n).cast("long").alias("limit_value")) for s, n in limits.items()])
    return counts.select(F.explode(rows).alias("g")).select("g.*").withColumn("passed", F.col("value") <= F.col("limit_value"))


def consensus(votes: DataFrame, threshold: float = 0.66, within: int = 3) -> DataFrame:
    """Groups provider issues (file, category, line within a tolerance, in order) and votes.

    Grouping is greedy and order-dependent: an issue joins the group whose first line is near, else it
    opens one.  Columns of ``votes``: file, category, line, provider, weight.
    """
    issues = F.array_sort(F.collect_list(F.struct("line", "provider", "weight")))
    groups = votes.groupBy(F.lower("file").alias("file"), "category").agg(issues.alias("i"))
    anchors = F.aggregate("i", F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) > 0) & (x["line"] - F.element_at(F.coalesce(F.when(F.size(acc) > 0, acc), F.array(x["line"].cast("bigint"))), -1) <= within), acc).otherwise(F.concat(acc, F.array(x["line"].cast("bigint")))))
    each = groups.select("file", "category", F.explode(F.transform("i", lambda x: F.struct(x["line"].alias("line"), x["provider"].alias("provider"), x["weight"].alias("weight")))).alias("x"), anchors.alias("a"))
    placed = each.select("file", "category", "x.*", F.array_max(F.filter("a", lambda v: v <= F.col("x.line"))).alias("anchor"))
    n = placed.agg(F.countDistinct("provider").alias("n_providers"))
    voted = placed.groupBy("file", "category", "anchor").agg(F.countDistinct("provider").alias("providers"), F.sum("weight").alias("weight")).join(n)
    return voted.withColumn("agreement", F.col("providers") / F.col("n_providers")).withColumn("accepted", F.col("agreement") >= threshold)


def knapsack(items: DataFrame, budget: int, most: int, cost: str, value: str, tie: str) -> DataFrame:
    """Greedy plan: by value, items that still fit the budget, at most ``most``.

    The plan itself is bounded by ``most``, but what fits depends on all taken before, so the fold runs
    over the items in order of value.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(tie).alias("id"), F.col(cost).cast("long").alias("c"))))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<bigint>").alias("taken"))
    fold = F.aggregate(ordered, start, lambda acc, x: F.when((x["c"] <= acc["left"]) & (F.size(acc["taken"]) < most), F.struct((acc["left"] - x["c"]).alias("left"), F.concat(acc["taken"], F.array(x["id"].cast("bigint"))).alias("taken"))).otherwise(acc))
    return items.where(F.col(cost) <= budget).agg(fold.alias("p")).select(F.posexplode("p.taken").alias("position", tie))


def confidence(static: Column, ai: Column, history: Column, context: Column, severity: Column) -> Column:
    """Weighted confidence of five factors; missing and zero values count as a half."""
    half = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(0.5))
    return clamp(0.4 * half(static) + 0.2 * half(ai) + 0.15 * half(history) + 0.15 * half(context) + 0.1 * half(severity), 0.0, 1.0)


def ewma(events: DataFrame, key: str, order: str, value: str, keep: float = 0.7) -> DataFrame:
    """key, n, risk: an order-dependent running mean, rounded half up to 3 digits at each step."""
    third = lambda x: F.floor(x * 1000 + 0.5) / 1000
    seq = F.array_sort(F.collect_list(F.struct(order, value)))
    fold = F.aggregate(F.slice(seq, 2, 2_000_000_000), third(F.element_at(seq, 1)[value]), lambda acc, x: third(acc * keep + x[value] * (1 - keep)))
    return events.groupBy(key).agg(F.count("*").alias("n"), fold.alias("risk"))


def confusion(rows: DataFrame, predicted: Column, actual: Column, by: str | None = None) -> DataFrame:
    """tp, fp, fn, tn with precision, recall, f1 and accuracy, in all or per group and in all."""
    cells = rows.withColumn("_p", predicted).withColumn("_a", actual)
    g = cells.rollup(by) if by else cells.groupBy()
    c = g.agg(F.count_if(F.col("_p") & F.col("_a")).alias("tp"), F.count_if(F.col("_p") & ~F.col("_a")).alias("fp"), F.count_if(~F.col("_p") & F.col("_a")).alias("fn"), F.count_if(~F.col("_p") & ~F.col("_a")).alias("tn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 4)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, state: str) -> DataFrame:
    """key, status of all keys of two snapshots: new, deleted, changed (another ``state``) or cached.  One row per key and side."""
    o = old.select(F.col(key).alias("_o"), F.col(state).alias("_os"), F.lit(True).alias("_in_old"))
    n = new.select(F.col(key).alias("_n"), F.col(state).alias("_ns"), F.lit(True).alias("_in_new"))
    same = F.col("_os").eqNullSafe(F.col("_ns"))
    status = F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "deleted").when(same, "cached").otherwise("changed")
    return o.join(n, F.col("_o") == F.col("_n"), "full").select(F.coalesce("_o", "_n").alias(key), status.alias("status"))
