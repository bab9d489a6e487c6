"""Counts, gates and report rows over scored findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift import fixed_values as V
from fleetsift.functions import severity as sev
from fleetsift.functions import text
from fleetsift.functions.first import first_per_group, top_per_group
from fleetsift.operators.scoring import by_risk
from fleetsift.schemas import FINDING_ORDER


# --- Aggregates ---------------------------------------------------------------

def _level() -> Column:
    return F.upper(F.coalesce("severity", F.lit("LOW")))


def severity_counts(findings: DataFrame, by: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Total and count per severity, zero where a level has none."""
    return findings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_count"),
        *[F.count_if(_level() == level).alias(level.lower()) for level in V.SEVERITY_RANK])


def type_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id").agg(
        *[F.count_if(F.col("finding_type") == t).alias(t) for t in V.FINDING_TYPES])


def report_verdict(critical: Column, high: Column) -> Column:
    return F.when(critical > 0, "FAIL").when(high > 0, "WARNING").otherwise("PASS")


def verdicts(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """FAIL with any critical finding, WARNING with any high one, else PASS; empty scans pass."""
    counts = severity_counts(findings).select("scan_id", "critical", "high")
    return scans.select("scan_id").join(counts, "scan_id", "left").select(
        "scan_id", report_verdict(F.coalesce("critical", F.lit(0)), F.coalesce("high", F.lit(0))).alias("verdict"))


def gate(scans: DataFrame, findings: DataFrame, threshold: Column | str = "HIGH") -> DataFrame:
    """Per scan: does any finding reach the threshold, and the exit code.

    `scans` carries `error`, not NULL where reading the repository failed; such
    a scan exits with 2.  Scans without findings pass.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    reached = findings.groupBy("scan_id").agg(
        F.bool_or(sev.at_or_above(F.coalesce("severity", F.lit("LOW")), limit)).alias("reached"))
    failed = F.coalesce("reached", F.lit(False))
    code = F.when(F.col("error").isNotNull(), 2).when(failed, 1).otherwise(0)
    return scans.select("scan_id", "error").join(reached, "scan_id", "left").select(
        "scan_id", failed.alias("failed"), code.alias("exit_code"))


def scan_status(exit_code: Column) -> Column:
    return F.when(exit_code.isin(0, 1), "done").otherwise("error")


def rule_columns() -> dict[str, Column]:
    """A rule as a finding shows it."""
    rule = F.coalesce("rule_id", F.lit("UNKNOWN"))
    name = F.coalesce("rule_name", rule)
    return {
        "rule_id": rule, "name": F.replace(name, F.lit(" "), F.lit("")), "short_description": name,
        "full_description": F.coalesce("description", F.lit("")),
        "level": sev.sarif_level(F.coalesce("severity", F.lit("MEDIUM"))),
        "help_uri": F.coalesce(text.blank_to_null(F.col("cve_reference")), F.concat(F.lit(V.ADVISORY_QUERY_URL), rule))}


def rule_definitions(findings: DataFrame, order: Sequence[str] = FINDING_ORDER, by: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Distinct rules per scan, each as its first finding in risk order shows it.

    `first_seen` sorts the rules as they first appear.
    """
    rule = rule_columns()
    rows = findings.select(
        *by, rule.pop("rule_id").alias("rule_id"),
        (-F.col("risk_score")).alias("risk_order"), *[F.col(c).alias(f"order_{i}") for i, c in enumerate(order)],
        *[value.alias(name) for name, value in rule.items()])
    ordering = ["risk_order", *[f"order_{i}" for i in range(len(order))]]
    first = first_per_group(rows, [*by, "rule_id"], ordering)
    return first.withColumn("first_seen", F.struct(*ordering, "rule_id")).drop(*ordering)


# --- Report rows --------------------------------------------------------------

def of_type(findings: DataFrame, finding_type: str) -> DataFrame:
    return findings if finding_type == "all" else findings.filter(F.col("finding_type") == finding_type)


def search(findings: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search over rule name, path and description."""
    haystack = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("rule_name", "file_path", "description")])
    return findings.filter(F.lower(haystack).contains(query.lower())) if query else findings


def at_or_above(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.filter(sev.at_or_above(F.coalesce("severity", F.lit("LOW")), F.lit(threshold)))


def summary_rows(findings: DataFrame) -> DataFrame:
    return findings.select(
        "scan_id", F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.round(F.coalesce("risk_score", F.lit(0.0)), 1).alias("score"),
        F.coalesce("finding_type", F.lit("?")).alias("finding_type"),
        F.coalesce("rule_id", F.lit("?")).alias("rule_id"),
        F.coalesce("file_path", F.lit("?")).alias("file_path"),
        F.substring(F.coalesce("description", F.lit("")), 1, V.SUMMARY_DESCRIPTION_CHARS).alias("description"))


def top_findings(findings: DataFrame, limit: int = V.SUMMARY_ROWS, order: Sequence[str] = FINDING_ORDER) -> DataFrame:
    """The `limit` riskiest findings of each scan, with their position and how many more there are.

    The limit is applied inside every task before the shuffle, and the counts
    come from a partial aggregate, so a very large scan is never in one task.
    """
    totals = findings.groupBy("scan_id").agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("more"))
    return top_per_group(findings, ["scan_id"], by_risk(order), limit).join(totals, "scan_id")


def score_bar_percent(score: Column) -> Column:
    return (score / F.lit(10.0) * F.lit(100.0)).cast("int")


def advisory_url(reference: Column) -> Column:
    return F.concat(F.lit(V.ADVISORY_QUERY_URL), reference)


def newest_reports(reports: DataFrame) -> DataFrame:
    """The newest report of each scan and extension; of two written at once, the greater path."""
    return reports.groupBy("scan_id", "ext").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def newest_first(scans: DataFrame, started: str = "started") -> DataFrame:
    return scans.orderBy(F.desc(started), F.desc("scan_id"))


def report_path(repo_name: Column, at: Column, extension: Column | str) -> Column:
    ext = F.lit(extension) if isinstance(extension, str) else extension
    slug = F.replace(repo_name, F.lit("/"), F.lit("_"))
    return F.concat(F.lit("audit_"), slug, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("."), ext)
