"""Risk scores from 0 to 10: exploitability + blast radius + trigger context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift import fixed_values as V
from fleetsift.functions.severity import band, mapped
from fleetsift.schemas import FINDING_ORDER


Parts = tuple[Column, Column, Column]


def secret_parts() -> Parts:
    path = F.col("file_path")
    base = mapped(F.col("rule_severity"), V.EXPLOITABILITY, 1.0)
    exploitability = F.when(F.col("confidence") == "HIGH", F.least(F.lit(4.0), base + F.lit(0.5))).otherwise(base)
    in_workflows = path.contains(".github/workflows")
    blast = (F.when(in_workflows, 3.0).when(path.startswith(".env"), 2.5)
             .when(F.lower(path).contains("docker"), 2.0).otherwise(1.0))
    context = F.when(in_workflows, 3.0).when(path.contains(".env"), 2.5).otherwise(1.0)
    return exploitability, blast, context


def misconfig_parts() -> Parts:
    triggers = F.coalesce("affected_triggers", F.array().cast("array<string>"))

    def among(*names: str) -> Column:
        return F.exists(triggers, lambda t: F.lower(t).isin(*names))

    exploitability = mapped(F.col("rule_severity"), V.EXPLOITABILITY, 2.0)
    blast = F.least(F.lit(3.0), F.lit(1.0) + F.size(triggers) * F.lit(0.5))
    context = F.when(among("pull_request", "pull_request_target"), 3.0).when(among("push"), 2.0).otherwise(1.0)
    return exploitability, blast, context


def dependency_parts() -> Parts:
    base = F.round(F.coalesce("base_score", F.lit(0.0)) / F.lit(10.0) * F.lit(4.0), 1)
    exploitability = F.when(F.col("attack_vector") == "NETWORK", F.least(F.lit(4.0), base + F.lit(0.5))).otherwise(base)
    return exploitability, F.lit(2.0), F.lit(2.0)


def score_findings(findings: DataFrame) -> DataFrame:
    """Add `breakdown`, `risk_score` and `severity`.

    The severity is the band of the score; what the rule said stays in
    `rule_severity`.  A finding of an unknown type scores 5.  Parts, total and
    band are separate steps, so none is computed twice.
    """
    kind = F.col("finding_type")
    names = ["_exploitability", "_blast_radius", "_trigger_context"]
    by_kind = zip(names, secret_parts(), misconfig_parts(), dependency_parts())
    parts = {name: F.when(kind == "secret", secret).when(kind == "misconfig", misconfig).when(kind == "dependency", dependency)
             for name, secret, misconfig, dependency in by_kind}
    total = F.round(F.least(F.lit(10.0), F.col(names[0]) + F.col(names[1]) + F.col(names[2])), 1)
    score = F.when(F.col(names[0]).isNull(), V.UNKNOWN_TYPE_SCORE).otherwise(total)
    return (findings.withColumns(parts)
            .withColumn("risk_score", score)
            .withColumn("severity", band(F.col("risk_score")))
            .withColumn("breakdown", F.struct(*[F.col(n).alias(n[1:]) for n in names], F.col("risk_score").alias("total")))
            .drop(*names))


def by_risk(order: Sequence[str] = FINDING_ORDER) -> list[Column]:
    return [F.desc("risk_score"), *[F.asc_nulls_first(c) for c in order]]


def sort_by_risk(scored: DataFrame, order: Sequence[str] = FINDING_ORDER) -> DataFrame:
    """Scan by scan, highest risk first.  A range sort on all keys: one large scan spreads over many tasks."""
    return scored.orderBy("scan_id", *by_risk(order))


def union_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
