"""Severity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetsift import fixed_values as V


def mapped(value: Column, table: dict, other) -> Column:
    expr = None
    for key, result in table.items():
        expr = F.when(value == key, F.lit(result)) if expr is None else expr.when(value == key, F.lit(result))
    return expr.otherwise(F.lit(other))


def severity_rank(severity: Column) -> Column:
    return mapped(severity, V.SEVERITY_RANK, V.UNKNOWN_SEVERITY_RANK)


def threshold_rank(threshold: Column) -> Column:
    return mapped(F.upper(threshold), V.SEVERITY_RANK, V.UNKNOWN_THRESHOLD_RANK)


def at_or_above(severity: Column, threshold: Column) -> Column:
    return severity_rank(severity) <= threshold_rank(threshold)


def sarif_level(severity: Column) -> Column:
    return mapped(F.upper(severity), V.SARIF_LEVELS, V.SARIF_OTHER_LEVEL)


def band(score: Column) -> Column:
    expr = None
    for floor, label in V.SEVERITY_BANDS:
        expr = F.when(score >= floor, label) if expr is None else expr.when(score >= floor, label)
    return expr.otherwise(V.LOWEST_BAND)
