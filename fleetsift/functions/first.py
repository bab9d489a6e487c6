"""First rows per group without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group by `order`; ties by the remaining columns, NULLs first.

    A minimum over structs, so each task keeps one row per group before the
    shuffle.  A group of any size costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("row"))
    return least.select(*keys, "row.*").select(*df.columns)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first `limit` rows of each group, numbered by `position`.

    Each input task's share of a group is cut to `limit` rows first, so a group
    of any size is never sorted whole by one task, whatever the limit.
    """
    by_group = Window.partitionBy(*keys).orderBy(*order)
    by_share = Window.partitionBy(*keys, "_share").orderBy(*order)
    cut = (df.withColumn("_share", F.spark_partition_id()).withColumn("_rank", F.row_number().over(by_share))
           .filter(F.col("_rank") <= limit).drop("_share", "_rank"))
    return cut.withColumn("position", F.row_number().over(by_group).cast("bigint")).filter(F.col("position") <= limit)
