"""Stores that take numbered batches exactly once, two stores kept alike, and results cached by content.

A batch is written as Parquet under its number and the number of the attempt; its manifest, written last and
renamed into place, says which attempt counts.  Readers see batches that have a manifest and no others, so a
batch that was killed is not seen, and one that comes again changes nothing.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; a temporary one only on a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='stratalens-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class BatchStore:
    """Rows of one schema in numbered batches."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), spark.createDataFrame([], schema).schema
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, kind: str, number: int) -> str:
        return f"{self.path}/manifests/{kind}-{number:012d}.json"

    def _publish(self, kind: str, number: int, folder: str) -> bool:
        """Whether this attempt is the one that counts: the first rename wins."""
        final, draft = self._manifest(kind, number), f"{self.path}/drafts/{uuid.uuid4().hex}"
        out = self._fs.create(self._at(draft), False)
        out.write(bytearray(json.dumps({"folder": folder}).encode()))
        out.close()
        self._fs.mkdirs(self._at(f"{self.path}/manifests"))
        won = not self._fs.exists(self._at(final)) and self._fs.rename(self._at(draft), self._at(final))
        if not won:
            self._fs.delete(self._at(draft), False)
        return won

    def _published(self, kind: str) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[len(kind) + 1 : -5]) for n in names if n.startswith(f"{kind}-") and n.endswith(".json"))

    def _folder(self, kind: str, number: int) -> str:
        text = self.spark.read.option("wholetext", True).text(self._manifest(kind, number)).first()[0]
        return f"{self.path}/data/{json.loads(text)['folder']}"

    def numbers(self) -> list[int]:
        """The numbers of all batches that count."""
        return self._published("batch")

    def write_rows(self, rows: DataFrame, number: int, kind: str = "batch") -> str:
        """Write an attempt, which nobody sees yet."""
        folder = f"{kind}={number}/attempt={uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(f"{self.path}/data/{folder}")
        return folder

    def ingest(self, rows: DataFrame, number: int) -> bool:
        """Take a batch; False, and no change, if its number has been taken before."""
        if number in self.numbers():
            return False
        return self._publish("batch", number, self.write_rows(rows, number))

    def batch(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._folder("batch", number))

    def read(self) -> DataFrame:
        """All rows with the number of their batch; compacted ones have the number up to which they were compacted."""
        bases = self._published("base")
        base = bases[-1] if bases else None
        parts = [("base", base)] if base is not None else []
        parts += [("batch", n) for n in self.numbers() if base is None or n > base]
        read = [self.spark.read.schema(self.schema).parquet(self._folder(k, n)).withColumn("batch", F.lit(n).cast("long")) for k, n in parts]
        empty = self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0).cast("long"))
        return reduce(DataFrame.unionByName, read, empty) if not read else reduce(DataFrame.unionByName, read)

    def state(self, keys: tuple[str, ...], added: tuple[str, ...] = ()) -> DataFrame:
        """A row per key: columns in ``added`` are summed over all batches, the others are those of the latest batch.

        In one batch the greatest row of a key counts for the others.
        """
        kept = [f.name for f in self.schema if f.name not in keys and f.name not in added]
        last = F.max(F.struct("batch", *kept)).alias("_last")
        rows = self.read().groupBy(*keys).agg(last, *[F.sum(c).alias(c) for c in added])
        return rows.select(*[F.col(f"_last.{f.name}").alias(f.name) if f.name in kept else F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])

    def upsert(self, rows: DataFrame, number: int, keys: tuple[str, ...], added: tuple[str, ...] = ()) -> DataFrame:
        """Take a batch and return the rows of its keys as they stand then, with ``inserted`` for new keys.

        A batch that was taken before returns the same rows as the first time, as long as no later one came.
        """
        earlier = [n for n in self.numbers() if n < number]
        known = self.read().where(F.col("batch") < number).select(*keys).distinct() if earlier else self.spark.createDataFrame([], self.schema).select(*keys)
        self.ingest(rows, number)
        now = self.state(keys, added).join(self.batch(number).select(*keys).distinct(), list(keys), "left_semi")
        return now.join(known.withColumn("_known", F.lit(True)), list(keys), "left").withColumn("inserted", F.col("_known").isNull()).drop("_known")

    def compact(self, keys: tuple[str, ...], added: tuple[str, ...] = ()) -> None:
        """Write the state as one base, which later reads take instead of the batches in it."""
        numbers = self.numbers()
        if numbers and numbers[-1] not in self._published("base"):
            self._publish("base", numbers[-1], self.write_rows(self.state(keys, added), numbers[-1], "base"))

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: a repeated micro-batch is taken once."""
        return lambda rows, number: None if self.ingest(rows, number) else None


def dual_write(first: BatchStore, second: BatchStore, rows: DataFrame, number: int) -> None:
    """Take a batch in both stores; the second one gets what the first one holds, so that both see the same rows."""
    first.ingest(rows, number)
    second.ingest(first.batch(number), number)


def replay(source: BatchStore, target: BatchStore) -> list[int]:
    """Copy the batches that the target lacks, in order; returns their numbers.  It can be stopped and started again."""
    missing = sorted(set(source.numbers()) - set(target.numbers()))
    for n in missing:
        target.ingest(source.batch(n), n)
    return missing


def differences(first: DataFrame, second: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys with ``status``: only_first, only_second or differs.  Rows are compared by all their columns, nulls alike."""
    others = sorted(set(first.columns) - set(keys))
    side = lambda df, n: df.select(*keys, F.struct(*others).alias(n), F.lit(True).alias(f"in_{n}"))
    a, b = side(first, "a"), side(second, "b")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    met = a.alias("l").join(b.alias("r"), on, "full")
    status = F.when(F.col("in_b").isNull(), "only_first").when(F.col("in_a").isNull(), "only_second").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return met.select(*[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys], status.alias("status")).where(F.col("status").isNotNull())


_ENTRIES = "content_hash string, version string, used_at timestamp, size long"


class ResultCache:
    """Results of a scan, kept by the hash of what was scanned and the version of the rules."""

    def __init__(self, spark: SparkSession, path: str, results: str, version: str) -> None:
        self.version = version
        self.entries, self.results = BatchStore(spark, f"{path}/entries", _ENTRIES), BatchStore(spark, f"{path}/results", f"content_hash string, {results}")

    def valid(self, now: Column, keep_hours: float) -> DataFrame:
        """content_hash and size of the entries of this version that were used in the last hours."""
        state = self.entries.state(("content_hash",))
        age = F.unix_timestamp(now) - F.unix_timestamp("used_at")
        return state.where((F.col("version") == self.version) & (age <= keep_hours * 3600) & (F.col("size") >= 0))

    def run(self, docs: DataFrame, scan: Callable[[DataFrame], DataFrame], number: int, now: Column, keep_hours: float = 24, text: str = "text") -> DataFrame:
        """The results of ``scan`` for all rows of ``docs``, with ``reused``; only contents without a valid entry are scanned, once each.

        ``scan`` takes (doc_id, text), where doc_id is the content hash, and returns its results with it.
        """
        hashed = docs.where(F.col(text).isNotNull()).select("doc_id", F.sha2(F.col(text), 256).alias("content_hash"), F.col(text).alias("text"))
        known = self.valid(now, keep_hours).select("content_hash")
        contents = hashed.groupBy("content_hash").agg(F.first("text").alias("text"), F.max(F.octet_length("text")).cast("long").alias("size"))
        todo = contents.join(known, "content_hash", "left_anti")
        found = scan(todo.select(F.col("content_hash").alias("doc_id"), "text")).withColumnRenamed("doc_id", "content_hash")
        self.results.ingest(found, number)
        used = contents.select("content_hash", F.lit(self.version).alias("version"), now.alias("used_at"), "size")
        scanned_now = F.lit(number).cast("long")
        self.entries.ingest(used, number)  # last: an entry stands for results that are there
        results = self.results.read()
        newest = results.groupBy("content_hash").agg(F.max("batch").alias("batch"))
        of_hash = results.join(newest, ["content_hash", "batch"], "left_semi")
        return hashed.select("doc_id", "content_hash").join(of_hash, "content_hash").withColumn("reused", F.col("batch") < scanned_now).drop("batch", "content_hash")

    def evicted(self, now: Column, max_bytes: int, keep_hours: float = 24) -> DataFrame:
        """content_hash of the entries that go: too old, or beyond ``max_bytes`` when the last used stay."""
        state = self.entries.state(("content_hash",)).withColumn("age", F.unix_timestamp(now) - F.unix_timestamp("used_at"))
        total = running(state, ["age", "content_hash"], F.floor(F.col("age") / 3600), held=("sum", "size"))
        return total.where((F.col("held") > max_bytes) | (F.col("age") > keep_hours * 3600)).select("content_hash")

    def evict(self, number: int, now: Column, max_bytes: int, keep_hours: float = 24) -> None:
        """Evicted entries are kept with size -1, which no reader counts as valid, until the next compaction."""
        gone = self.evicted(now, max_bytes, keep_hours)
        self.entries.ingest(gone.select("content_hash", F.lit(self.version).alias("version"), now.alias("used_at"), F.lit(-1).cast("long").alias("size")), number)


def ingest_all(store: BatchStore, rows: DataFrame, number_of: Column, numbers: Iterable[int]) -> None:
    """Take ``rows`` as batches by their number, in order."""
    for n in numbers:
        store.ingest(rows.where(number_of == n), n)
