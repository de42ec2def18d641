"""What is learnt from outcomes: category factors, root causes, ranked recommendations, providers, insights, gates and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PRIORITY, by_severity, path_pattern
from .ordered import running


def category_factors(outcomes: DataFrame, order: list[Column], newest: int = 500, rate: float = 0.1) -> DataFrame:
    """category, n, factor: stochastic steps over the ``newest`` outcomes (score, accepted) in ``order``, kept between 0.5 and 1.5.

    Each step adds ``rate`` times the error of the score and depends on the one before, so a category is a fold
    over its rows; their number is bounded by ``newest``, the feature's own limit.
    """
    few = outcomes.orderBy(*order).limit(newest).withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    error = F.col("accepted").cast("double") - F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(0.5))
    steps = F.array_sort(F.collect_list(F.struct("_at", error.alias("e"))))
    fold = F.aggregate(steps, F.lit(1.0), lambda f, x: F.greatest(F.lit(0.5), F.least(F.lit(1.5), f + rate * x["e"])))
    return few.groupBy("category").agg(F.count("*").alias("n"), F.round(fold, 6).alias("factor"))


def boosted(factors: DataFrame, incidents: DataFrame) -> DataFrame:
    """category, factor after 15 % more for each incident of the category, at most 2; categories without a factor begin at 1."""
    n = incidents.where("category is not null").groupBy("category").agg(F.count("*").alias("_n"))
    joined = factors.select("category", "factor").join(n, "category", "full")
    base = F.coalesce("factor", F.lit(1.0))
    return joined.select("category", F.when(F.col("_n").isNull(), base).otherwise(F.least(base * F.pow(F.lit(1.15), "_n"), F.lit(2.0))).alias("factor"))


def root_causes(clusters: DataFrame) -> DataFrame:
    """cluster, cause, at, confidence: one pattern of paths is localised, one category systemic, anything else distributed."""
    c = clusters.withColumn("_p", path_pattern("file")).groupBy("cluster").agg(F.countDistinct("_p").alias("paths"), F.countDistinct("category").alias("kinds"), F.min("_p").alias("path"), F.min("category").alias("kind"))
    here, same = F.col("paths") == 1, F.col("kinds") == 1
    pick = lambda a, b, d: F.when(here, a).when(same, b).otherwise(d)
    return c.select("cluster", pick("localized", "systemic", "distributed").alias("cause"), pick(F.col("path"), F.col("kind"), F.lit("")).alias("at"), pick(F.lit(0.8), F.lit(0.7), F.lit(0.3)).alias("confidence"))


def ranked_recommendations(findings: DataFrame, clusters: DataFrame, fixers: DataFrame) -> DataFrame:
    """The findings with score, confidence and priority.

    Severity weight (10 if unknown) times impact (1 if null or 0), plus ten times the logarithm of the size of
    the largest cluster (category, size) of over two; confidence is the category's mean (category, mean), or a half.
    """
    size = clusters.groupBy("category").agg(F.max("size").alias("_size"))
    means = fixers.select("category", F.col("mean").alias("_mean"))
    base = by_severity("severity", PRIORITY, 10) * F.coalesce(F.nullif("impact", F.lit(0)), F.lit(1))
    bonus = F.when(F.col("_size") > 2, 10 * F.log(F.col("_size").cast("double"))).otherwise(F.lit(0.0))
    out = findings.join(F.broadcast(size), "category", "left").join(F.broadcast(means), "category", "left")  # a row per category
    out = out.withColumn("score", F.round(base + bonus, 4)).withColumn("confidence", F.coalesce("_mean", F.lit(0.5)))
    both = F.col("score") * F.col("confidence")
    return out.drop("_size", "_mean").withColumn("priority", F.when(both > 100, "CRITICAL").when(both > 50, "HIGH").when(both > 20, "MEDIUM").otherwise("LOW"))


def ranked_providers(stats: DataFrame) -> DataFrame:
    """provider, score, place: 0.6 of the success rate and 0.4 of the mean confidence in per cent; ties by name."""
    s = stats.select("provider", F.round(0.6 * F.col("success_rate") + 0.4 * F.col("confidence") / 100, 6).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "provider")).cast("long"))  # a row per provider


def failing_categories(outcomes: DataFrame, most: int = 5) -> DataFrame:
    """category, failures: the categories of most failed outcomes; ties by name."""
    return outcomes.where(~F.col("success") & F.col("category").isNotNull()).groupBy("category").agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "category").limit(most)


def auto_remediated(incidents: DataFrame, order: list[str], bucket: Column, budget: int) -> DataFrame:
    """The incidents that are remedied at once: neither critical nor high, the first ``budget`` of these in order."""
    mild = incidents.where(~F.col("severity").isin("CRITICAL", "HIGH"))
    return running(mild, order, bucket, _k=("count", "*")).where(F.col("_k") <= budget).drop("_k")


def audit_ring(entries: DataFrame, order: list[Column], size: int = 10_000) -> DataFrame:
    """The newest ``size`` entries, with a hash of their content that shows later changes."""
    kept = entries.orderBy(*order).limit(size)
    return kept.withColumn("integrity", integrity(kept.columns))


def integrity(columns: list[str]) -> Column:
    """SHA-256 of the columns as text, nulls apart from empty ones."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def fix_confidence(match: Column, matches: Column, complexity: Column, context: Column, quality: Column, history: Column) -> tuple[Column, Column]:
    """Score and level (high from 0.9, medium from 0.75, else low) of a fix from five weighted factors."""
    form = F.when(match == "exact", 1.0).when(match == "partial", 0.7).otherwise(0.5) * F.when(matches <= 1, 1.0).when(matches <= 3, 0.9).otherwise(0.7)
    ease = F.when(complexity <= 5, 1.0).when(complexity <= 10, 0.8).when(complexity <= 15, 0.6).when(complexity <= 20, 0.4).otherwise(0.2)
    score = F.round(0.3 * form + 0.25 * ease + 0.2 * context + 0.15 * quality + 0.1 * history, 6)
    return score, F.when(score >= 0.9, "high").when(score >= 0.75, "medium").otherwise("low")


def format_bytes(size: Column) -> Column:
    """``1536`` as ``1.50 KB``, up to GB; halves are rounded up."""
    unit = F.when(size < 1024, 0).when(size < 1024**2, 1).when(size < 1024**3, 2).otherwise(3)
    return F.concat(F.format_string("%.2f", F.floor(size / F.pow(F.lit(1024.0), unit) * 100 + 0.5) / 100), F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), unit + 1))


def memory_tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, longer than two characters."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " "), " "), lambda w: F.length(w) > 2)


def full_text_search(rows: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Rows whose text holds every one of ``words``, as whole words and whatever their case."""
    have = F.transform(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w)
    ok = F.lit(True)
    for w in words:
        ok = ok & F.array_contains(have, w.lower())
    return rows.where(ok)


#: Words of error types and the categories that they stand for.
ERROR_WORDS = (
    ("DATABASE", ("sql", "database", "query")), ("SECURITY", ("auth", "permission", "forbidden", "unauthorized")),
    ("RELIABILITY", ("null", "undefined", "reference", "type")), ("PERFORMANCE", ("timeout", "connection", "network", "memory", "heap", "stack")),
)
OTHER_ERRORS = "RELIABILITY"


def inferred_category(error_type: Column) -> Column:
    """The category of a rule that is proposed for an error type; the first that holds one of its words."""
    t, out = F.lower(error_type), F.lit(OTHER_ERRORS)
    for category, words in reversed(ERROR_WORDS):
        holds = F.lit(False)
        for w in words:
            holds = holds | t.contains(w)
        out = F.when(holds, category).otherwise(out)
    return out


def test_results(payloads: DataFrame) -> DataFrame:
    """name, file, suite, passed, error of test reports (format, body as JSON): jest, mocha, pytest and a plain list."""
    get = lambda body: F.col(body)

    def of(kinds: tuple[str, ...], schema: str) -> DataFrame:
        return payloads.where(F.col("format").isin(*kinds)).select(F.from_json("body", schema).alias("r"))

    jest = of(("jest",), "testResults array<struct<name:string,assertionResults:array<struct<title:string,ancestorTitles:array<string>,status:string,failureMessages:array<string>>>>>")
    jest = jest.select(F.explode("r.testResults").alias("f")).select("f.name", F.explode("f.assertionResults").alias("t"))
    jest = jest.select(F.col("t.title").alias("name"), F.col("name").alias("file"), F.array_join("t.ancestorTitles", " > ").alias("suite"), (F.col("t.status") == "passed").alias("passed"), F.array_join("t.failureMessages", "\n").alias("error"))
    mocha = of(("mocha",), "tests array<struct<title:string,file:string,fullTitle:string,state:string,err:struct<message:string>>>").select(F.explode("r.tests").alias("t"))
    mocha = mocha.select(get("t.title").alias("name"), get("t.file").alias("file"), get("t.fullTitle").alias("suite"), (get("t.state") == "passed").alias("passed"), get("t.err.message").alias("error"))
    pytest = of(("pytest",), "tests array<struct<nodeid:string,location:array<string>,outcome:string,longrepr:string>>").select(F.explode("r.tests").alias("t"))
    pytest = pytest.select(get("t.nodeid").alias("name"), F.try_element_at("t.location", F.lit(1)).alias("file"), F.try_element_at("t.location", F.lit(3)).alias("suite"), (get("t.outcome") == "passed").alias("passed"), get("t.longrepr").alias("error"))
    plain = of(("junit", "generic"), "array<struct<name:string,test:string,file:string,filePath:string,suite:string,describe:string,passed:boolean,status:string,error:string,message:string>>").select(F.explode("r").alias("t"))
    plain = plain.select(F.coalesce("t.name", "t.test", F.lit("unknown")).alias("name"), F.coalesce("t.file", "t.filePath").alias("file"), F.coalesce("t.suite", "t.describe").alias("suite"), (F.coalesce("t.passed", F.lit(False)) | F.coalesce(get("t.status") == "passed", F.lit(False))).alias("passed"), F.coalesce("t.error", "t.message").alias("error"))
    return jest.unionByName(mocha).unionByName(pytest).unionByName(plain)
