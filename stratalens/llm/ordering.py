"""Rows in a global key order, dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def in_key_order(df: DataFrame, key: str) -> DataFrame:
    """Range-partition by ``key`` and sort each partition: partition numbers then follow the key.

    Equal keys share a partition; nulls come first.  The number of partitions is the session's, which
    adaptive execution may lower by joining neighbours.
    """
    return df.repartitionByRange(key).sortWithinPartitions(key)
