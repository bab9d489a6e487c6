"""Scan logs.  Each function takes a static or a streaming DataFrame of `scan_logs`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift import fixed_values as V
from fleetsift.operators.report import scan_status

LEVELS = ["critical", "high", "medium", "low"]


def clean_lines(logs: DataFrame) -> DataFrame:
    """Trim each line on the right and drop those with nothing left."""
    trimmed = F.regexp_replace("line", r"(?U)[\s\x1C-\x1F]+$", "")
    return logs.withColumn("line", trimmed).filter("line <> ''")


def line_class(line: Column) -> Column:
    """How a log view colours the line; the first class that matches counts."""
    expr = None
    for name, pattern in V.LOG_LINE_CLASSES:
        expr = F.when(line.rlike(pattern), name) if expr is None else expr.when(line.rlike(pattern), name)
    return expr.otherwise("")


def summary_of(line: Column) -> Column:
    """The four counts of a completion line; NULL for any other line."""
    counts = F.struct(*[F.regexp_extract(line, V.SUMMARY_LINE_PATTERN, i + 1).cast("bigint").alias(level)
                        for i, level in enumerate(LEVELS)])
    return F.when(line.rlike(V.SUMMARY_LINE_PATTERN), counts)


def log_stats(logs: DataFrame) -> DataFrame:
    """Per scan: line count and the counts of the last completion line, zeros if there is none.

    Streams keep one row of state per scan.
    """
    summary = summary_of(F.col("line"))
    position = F.when(summary.isNotNull(), F.struct("ts", "line_no"))
    grouped = clean_lines(logs).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("log_count"), F.max_by(summary, position).alias("summary"))
    return grouped.select("scan_id", "log_count",
                          *[F.coalesce(F.col(f"summary.{level}"), F.lit(0)).alias(level) for level in LEVELS])


def status_snapshots(stats: DataFrame, exits: DataFrame, reports: DataFrame) -> DataFrame:
    """Log stats with the scan's status and report name.

    `exits` (scan_id, exit_code) holds the scans that ended; others are running.
    `reports` (scan_id, report) holds the newest report of each scan.
    """
    ended = exits.select("scan_id", scan_status(F.col("exit_code")).alias("status"))
    return (stats.join(ended, "scan_id", "left").join(reports.select("scan_id", "report"), "scan_id", "left")
            .withColumn("status", F.coalesce("status", F.lit("running"))))
