"""Shared storage for intermediate tables.

Lineage is cut by Parquet tables in the folder named by ``spark.checkpoint.dir``.  Only where that
setting is absent and the master is local (unit tests, a laptop) a temporary folder of this machine is
used instead; on a cluster without the setting, nothing is written and an error is raised.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import time
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="stratalens-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str, collect: bool = True) -> DataFrame:
    spark, schema = df.sparkSession, df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    if collect:
        release(spark)
    return spark.read.schema(schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; survives lost executors."""
    return _write(df, new_path(df.sparkSession, name))


class Scratch:
    """Intermediate tables that are deleted as soon as their last reader has been written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str, collect: bool = True) -> DataFrame:
        """``collect``: also let go of the shuffle files behind it (worth while after large shuffles)."""
        path = new_path(self.spark, name)
        out = _write(df, path, collect)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t))
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now; it does so when the driver's garbage is collected.

    Twice, because proxies that Python lets go of are dropped from the JVM's side a moment later.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.05)


def trim() -> None:
    """Give what a Python worker has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package also where PYTHONPATH does not name it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
