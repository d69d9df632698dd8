"""Numbering within groups of any size, without one task per group.

A group is first split at approximate quantiles into ``BUCKETS`` ranges of about equal size. Totals of the ranges are a
small relation; their running sums give each range its offset, and the exact work happens inside a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def with_bucket(df: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """Add ``bucket``: ranges of ``value`` in ascending order within each key."""
    if buckets <= 1:
        return df.withColumn("bucket", F.lit(0))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, cuts, 20 * buckets).alias("bounds"))
    inside = F.size(F.filter("bounds", lambda b: b < F.col(value)))
    return df.join(bounds, keys).withColumn("bucket", inside).drop("bounds")


def numbered_rows(df: DataFrame, keys: list[str], order: str, tie: str, carry: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``rank`` from 1 within each key by (order, tie), and ``previous_c`` / ``next_c`` for carried columns.

    With several buckets a key that holds a large part of all rows is ordered range by range; ranks
    and neighbours are continued across ranges from one summary row per range.
    """
    spread = with_bucket(df, keys, order, buckets)
    w = Window.partitionBy(*keys, "bucket").orderBy(order, tie)
    local = spread.select(
        *df.columns,
        "bucket",
        F.row_number().over(w).alias("rank"),
        *[F.lag(c).over(w).alias(f"previous_{c}") for c in carry],
        *[F.lead(c).over(w).alias(f"next_{c}") for c in carry],
    )
    place = F.struct(order, tie)
    ends = spread.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min_by(c, place).alias(f"first_{c}") for c in carry],
        *[F.max_by(c, place).alias(f"last_{c}") for c in carry],
    )
    across = Window.partitionBy(*keys).orderBy("bucket")
    edges = ends.select(
        *keys,
        "bucket",
        "n",
        F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        *[F.lag(f"last_{c}").over(across).alias(f"edge_previous_{c}") for c in carry],
        *[F.lead(f"first_{c}").over(across).alias(f"edge_next_{c}") for c in carry],
    )
    first, last = F.col("rank") == 1, F.col("rank") == F.col("n")
    return local.join(edges, [*keys, "bucket"]).select(
        *df.columns,
        (F.col("before") + F.col("rank")).alias("rank"),
        *[F.when(first, F.col(f"edge_previous_{c}")).otherwise(F.col(f"previous_{c}")).alias(f"previous_{c}") for c in carry],
        *[F.when(last, F.col(f"edge_next_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in carry],
    )
