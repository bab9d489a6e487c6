"""Work on keys and groups that may hold a large share of all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Keys that are salted at most, counters of the sketch that finds them, ranges of an order.
HEAVY_KEYS, COUNTERS, RANGES = 64, 10_000, 64

# Rows that a task sorts at most, and those for which a task of its own is worth while.
TASK_ROWS, LEAST_ROWS = 200_000, 10_000


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df: DataFrame) -> int:
    """Tasks that sort the rows in memory: at most TASK_ROWS each, if they are dealt evenly; few where there are few rows."""
    n = df.count()
    return max(1, -(-n // TASK_ROWS), min(shuffle_tasks(df), -(-n // LEAST_ROWS)))


def heavy_keys(df: DataFrame, keys: Sequence[str], tasks: int) -> dict[int, int]:
    """Hash of each key that holds more rows than a task's even share -> pieces of about that share.

    A frequency sketch over one pass; what reaches the driver is its few largest counters.  Keys
    beyond HEAVY_KEYS would each hold less than 1 / HEAVY_KEYS of the rows.
    """
    hashed = df.select(F.xxhash64(*keys).alias("k"))
    found = hashed.agg(F.expr(f"approx_top_k(k, {HEAVY_KEYS}, {COUNTERS})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return {t["item"]: math.ceil(t["count"] * tasks / found["n"]) for t in found["top"] or [] if t["count"] * tasks > found["n"]}


def join_spread(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Inner join of `rows` with `lookup`, which has one row per key; heavy keys are joined in pieces.

    Rows of a heavy key are dealt to several pieces and its one lookup row is repeated for each, so
    no task gets much more than an even share, however the rows spread over keys.
    """
    pieces = heavy_keys(rows, keys, tasks or shuffle_tasks(rows))
    if not pieces:
        return rows.join(lookup, list(keys))
    known = F.create_map(*[F.lit(x) for item in pieces.items() for x in item])
    n = F.coalesce(known[F.xxhash64(*keys)], F.lit(1))
    dealt = rows.withColumn("_piece", F.pmod(F.monotonically_increasing_id(), n).cast("int"))
    repeated = lookup.withColumn("_piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.join(repeated, [*keys, "_piece"]).drop("_piece")


def range_of(column: str, boundaries: Sequence[int]) -> Column:
    """How many of the ascending boundaries are at or below the column, by binary search."""
    if not boundaries:
        return F.lit(0)
    bounds, n = F.array(*[F.lit(b) for b in boundaries]), len(boundaries)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & (F.element_at(bounds, F.least(at + step, F.lit(n))) <= F.col(column)), at + step).otherwise(at))


def quantile_boundaries(df: DataFrame, column: str, ranges: int = RANGES) -> list[int]:
    """Values that part the rows into ranges of about equal numbers of rows, however they are spaced."""
    points = [k / ranges for k in range(1, ranges)]
    found = df.agg(F.percentile_approx(column, points, 100 * ranges)).first()[0]
    return sorted(set(found or []))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, folder: str, tasks: int | None = None) -> DataFrame:
    """Adds the place, from 1, of each row of its group in ascending order, without a task that sees more of a group than about an even share.

    Groups within a task's share are numbered where one shuffle brings them together; only rows of
    heavy groups take the two passes of `numbered_in_ranges`, by way of `folder`.
    """
    rows = df.dropna(subset=list(group))
    heavy = list(heavy_keys(rows, group, tasks or shuffle_tasks(rows)))
    if not heavy:
        return _numbered_together(rows, group, order, name)
    is_heavy = F.xxhash64(*group).isin(heavy)
    return (_numbered_together(rows.filter(~is_heavy), group, order, name)
            .unionByName(numbered_in_ranges(rows.filter(is_heavy), group, order, name, folder)))


def _numbered_together(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))


def numbered_in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, folder: str) -> DataFrame:
    """Adds the place, from 1, of each row of its group in ascending order, without a task that sees a whole group.

    Two passes: rows are range-partitioned by group and order and written to `folder` with the
    number of their range, then counted for each group and range; a row's place is the count of the
    ranges before its own plus its place inside.  A group has at most as many ranges as there are tasks.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(folder)
    stored = df.sparkSession.read.schema(ranged.schema).parquet(folder)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_count"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0))).drop("_count")
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    return (stored.withColumn("_inside", inside).join(offsets, [*group, "_range"])
            .withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before"))
