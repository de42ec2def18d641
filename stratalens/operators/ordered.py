"""Running totals over a whole ordered table without bringing it to one task.

The table is cut into buckets that follow the order (days, thousands of ids).  Each bucket is summed where
it lies, the sums of the buckets before it, a row each, are its base, and only the rows inside a bucket
are put in order together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, order: list[str], bucket: Column, by: tuple[str, ...] = (), **totals: tuple[str, str]) -> DataFrame:
    """``rows`` with a running total per name, up to and with each row: ("sum" | "max", column) or ("count", "*").

    ``bucket`` does not decrease along ``order``.  Nulls in a column do not count; before the first value
    a sum or a maximum is null.
    """
    kinds = {"sum": F.sum, "max": F.max, "count": F.count}
    keyed = rows.withColumn("_bucket", bucket)
    keys = [*by, "_bucket"]
    each = keyed.groupBy(*keys).agg(*[kinds[k](c).alias(f"_{n}") for n, (k, c) in totals.items()])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[(F.max if k == "max" else F.sum)(f"_{n}").over(before).alias(f"_base_{n}") for n, (k, _) in totals.items()])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = keyed.join(base, on)

    def total(n: str, kind: str, column: str) -> Column:
        own, earlier = kinds[kind](column).over(inside), F.col(f"_base_{n}")
        if kind == "max":
            return F.greatest(own, earlier)
        return F.when(own.isNull(), earlier).otherwise(own + F.coalesce(earlier, F.lit(0)))

    return joined.select(*rows.columns, *[total(n, k, c).alias(n) for n, (k, c) in totals.items()])
