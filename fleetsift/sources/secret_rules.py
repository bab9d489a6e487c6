"""The catalogue of secret rules, and how callers add to it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fleetsift import fixed_values as V


@dataclass(frozen=True)
class SecretRule:
    id: str
    name: str
    pattern: str
    severity: str
    description: str
    cve_reference: str | None = None
    # Lower-case texts of which a file must hold one before the pattern can
    # match.  Empty means: no such text is known, always try the pattern.
    hints: tuple[str, ...] = ()


# A literal part of each built-in pattern, folded to lower case.
_HINTS = {
    "SEC001": ("akia",),
    "SEC002": ("aws",),
    "SEC003": ("ghp_",),
    "SEC004": ("gho_",),
    "SEC005": ("ghu_", "ghs_", "ghr_"),
    "SEC006": ("apikey", "api_key", "api-key"),
    "SEC007": (" private key-----",),
    "SEC008": ("eyj",),
    "SEC009": ("xox",),
    "SEC010": ("aiza",),
    "SEC011": ("sk_live_", "sk_test_"),
    "SEC012": ("passw", "pwd"),
    "SEC013": ("mongodb://", "postgresql://", "mysql://", "redis://"),
    "SEC014": ("_authtoken",),
    "SEC015": ("docker",),
}

BUILT_IN = [SecretRule(*fields, hints=_HINTS[fields[0]]) for fields in V.SECRET_RULES]


def secret_rules(spark: SparkSession, extra: Iterable[SecretRule] = ()) -> DataFrame:
    """The catalogue as a DataFrame."""
    rows = [(r.id, r.name, r.pattern, r.severity, r.description, r.cve_reference) for r in [*BUILT_IN, *extra]]
    return spark.createDataFrame(
        rows, "id string, name string, pattern string, severity string, description string, cve_reference string")
