"""Structured Streaming versions of the event operators; each has a batch twin over the same columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def error_rate(events: DataFrame, window: str = "5 minutes", limit: float = 0.05, late: str = "10 minutes") -> DataFrame:
    """window_start, n, errors, rate, alert per window; works on a stream and on a table."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = e.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    rate = F.col("errors") / F.col("n")
    return w.select(F.col("w.start").alias("window_start"), "n", "errors", F.round(rate, 4).alias("rate"), (rate > limit).alias("alert"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, n_events of bursts without a longer pause than ``gap``."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"))
    return s.select("user_id", F.col("s.start").alias("session_start"), "n_events")


def without_replays(events: DataFrame, key: tuple[str, ...], late: str = "1 hour") -> DataFrame:
    """The first event of each key; on a stream keys are forgotten after ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key)) if events.isStreaming else events.dropDuplicates(list(key))


def running_cost(events: DataFrame, by: str, value: str) -> DataFrame:
    """Totals per group."""
    return events.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))


def flush_batches(stream: DataFrame, path: str, trigger: str = "30 seconds"):
    """A query that writes a stream to Parquet in micro-batches."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}/_checkpoint").trigger(processingTime=trigger).start()


def drained(spark: SparkSession, folder: str, schema: str, build, mode: str = "complete", **options) -> DataFrame:
    """The result of ``build(stream)`` after all files of ``folder`` have passed, as a Parquet table.

    Micro-batches are written from the executors, each under its number so that a repeated one replaces
    itself; in complete mode the last one is the result.  Table and checkpoint lie in the folder that
    ``spark.checkpoint.dir`` names; only on a local master without it, in a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='stratalens-')}"
    path = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        done.append(number)

    stream = build(spark.readStream.schema(schema).options(**options).parquet(folder))
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    parts = done[-1:] if mode == "complete" else done
    return spark.read.schema(stream.schema).parquet(*[f"{path}/rows/batch={n}" for n in dict.fromkeys(parts)])
