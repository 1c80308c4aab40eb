"""Numbers in the order of a group's rows, however large the group is.

A window gives a group to one task. Here rows are dealt to ranges of (group, order), so a large group lies in many ranges in
a row. Each range numbers its own rows, and a row's number is its place there plus the number of its group's rows in
the ranges before, which follows from one row per group and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name``, the place of each row in its group by ``order`` (ascending, nulls first) from ``first`` on.

    Rows equal in ``group`` and ``order`` are numbered in any order. The result is read from files, so the numbers stay.
    """
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    # The number of a row within its partition is in the low bits; partitions are numbered as the ranges are.
    placed = ranged.withColumn("_range", F.spark_partition_id()).withColumn(
        "_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = materialize(placed, "ranges")
    parts = rows.groupBy("_range", *group).agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + first).select(
        F.col("_range").alias("_at"), *[F.col(g).alias(f"_group{i}") for i, g in enumerate(group)], "_shift")
    same = F.col("_range") == F.col("_at")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_group{i}"))
    return rows.join(shifts, same).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_local") + F.col("_shift")).alias(name))
