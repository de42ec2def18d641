"""What a run foretells of the next one, and which test tells of a score.

Runs of a project come in order.  What has been seen up to a run is its state: how often a category of one run was
followed by another in the next.  Every run is predicted from the state before it and held against what came, so that
nothing is predicted from itself.  The state is carried as a running count for each pair of categories that a project
has ever shown, one window over the runs, and never as pairs of runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def followed(runs: DataFrame) -> DataFrame:
    """project, i, category, next_i: the distinct categories of each run, numbered in order; runs are (project, run, category).

    Rows without a project or category are left out.  The last run has no next one.
    """
    each = runs.where("project is not null and category is not null").select("project", "run", "category").distinct()
    return each.select("project", F.dense_rank().over(Window.partitionBy("project").orderBy("run")).cast("long").alias("i"), "run", "category")


def predictions(runs: DataFrame, least: float = 0.5) -> DataFrame:
    """project, run, category, score, came: what each run but the last foretells for the next, and whether it came.

    P(to | from) is the share of ``to`` among what has followed ``from`` in earlier runs of the project; the score of a
    category is the sum over the categories of the run.  Scores below ``least`` foretell nothing.
    """
    now = followed(runs)
    ahead = now.select("project", (F.col("i") - 1).alias("i"), F.col("category").alias("to"))
    here = now.select("project", "i", "run", F.col("category").alias("was"))
    steps = here.join(ahead, ["project", "i"]).where("was <> to")
    pairs = steps.select("project", "was", "to").distinct()
    last = now.groupBy("project").agg(F.max("i").alias("last"))
    rows = here.join(last, "project").where("i < last").join(pairs, ["project", "was"]).join(steps.select("project", "i", "was", "to", F.lit(1).alias("hit")), ["project", "i", "was", "to"], "left")
    before = Window.partitionBy("project", "was", "to").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("seen", F.coalesce(F.sum(F.coalesce("hit", F.lit(0))).over(before), F.lit(0)))
    total = F.sum("seen").over(Window.partitionBy("project", "i", "was"))
    share = F.when(total > 0, F.col("seen") / total).otherwise(0.0)
    scored = counted.withColumn("p", share).groupBy("project", "i", "run", "to").agg(F.round(F.sum("p"), 6).alias("score")).where(F.col("score") >= least)
    came = ahead.withColumn("came", F.lit(True))
    return scored.join(came, ["project", "i", "to"], "left").select("project", "run", F.col("to").alias("category"), "score", F.coalesce("came", F.lit(False)).alias("came"))


def quality(predicted: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: predicted, right, came (categories of all runs that had one before), precision and recall."""
    actual = followed(runs).where("i > 1").agg(F.count("*").alias("came"))
    hits = predicted.agg(F.count("*").alias("predicted"), F.count_if("came").alias("right"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return hits.join(actual).select("predicted", "right", "came", share("right", "predicted").alias("precision"), share("right", "came").alias("recall"))  # one row each


def matched_tests(scores: DataFrame, tests: DataFrame) -> DataFrame:
    """score_id, kind, test: the test that tells of each score (score_id, base, keyword); tests are (test, keyword).

    The parts of test names (runs of letters and digits) are an index: a score whose ``base`` is a part of one test
    alone is matched by it ("unique"); else one whose keyword some test has, by the least of them ("keyword"); the
    others stand for the whole suite ("suite", no test).  Null bases and keywords match nothing.
    """
    parts = tests.select("test", F.explode(F.array_distinct(F.filter(F.split(F.lower("test"), "[^a-z0-9]+"), lambda p: p != ""))).alias("base"))
    by_part = parts.groupBy("base").agg(F.count("*").alias("n"), F.min("test").alias("by_name")).where("n = 1").drop("n")
    by_word = tests.where("keyword is not null").groupBy("keyword").agg(F.min("test").alias("by_word"))
    met = scores.withColumn("base", F.lower("base")).join(by_part, "base", "left").join(by_word, "keyword", "left")
    kind = F.when(F.col("by_name").isNotNull(), "unique").when(F.col("by_word").isNotNull(), "keyword").otherwise("suite")
    return met.select("score_id", kind.alias("kind"), F.coalesce("by_name", "by_word").alias("test"))
