"""Table schemas shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPO_FILES = (
    "repo_url string, scan_id bigint, path string, content string, file_type string, size_bytes bigint, "
    "is_workflow boolean, is_env_file boolean, is_dockerfile boolean, is_dependency_manifest boolean"
)

# One finding as a rule yields it, before it is tied to a scan.
RULE_HIT = (
    "rule_id string, rule_name string, line_number bigint, rule_severity string, description string, "
    "detail string, source string, cve_reference string, fix_suggestion string, affected_triggers array<string>"
)

# The wide table all scanners are unioned into.  `scanner_rank`, `file_path`,
# `line_number`, `rule_id` and `item_index` give a total order within a scan.
FINDINGS = (
    "repo_url string, scan_id bigint, scanner_rank int, item_index bigint, "
    "rule_id string, rule_name string, file_path string, line_number bigint, finding_type string, "
    "rule_severity string, description string, detail string, source string, confidence string, "
    "cve_reference string, fix_suggestion string, affected_triggers array<string>, "
    "package_name string, installed_version string, fixed_version string, cve_id string, ecosystem string, "
    "attack_vector string, base_score double, `references` array<string>"
)
SCORED_FINDINGS = FINDINGS + (
    ", breakdown struct<exploitability:double,blast_radius:double,trigger_context:double,total:double>, "
    "risk_score double, severity string"
)
FINDING_ORDER = ["scanner_rank", "file_path", "line_number", "rule_id", "item_index"]

SCANS = (
    "scan_id bigint, repo_url string, scanned_at timestamp, total_count bigint, "
    "critical bigint, high bigint, medium bigint, low bigint"
)
FINDING_HISTORY = (
    "scan_id bigint, file_path string, line_number bigint, finding_type string, rule_id string, "
    "severity string, risk_score double, status string, description string, fix_snippet string"
)
CVE_FEED = (
    "cve_id string, base_score double, severity string, attack_vector string, "
    "privileges_required string, description string, `references` array<string>, fetched_at timestamp"
)
SCAN_LOGS = "scan_id bigint, ts timestamp, line_no bigint, line string"

# A workflow definition after parsing (see operators.workflows).
WORKFLOW = (
    "triggers array<string>, perms_str string, perms map<string,string>, perms_named boolean, "
    "jobs array<struct<job_idx int, job_name string, perms_str string, perms map<string,string>, "
    "perms_named boolean, steps_kind string, "
    "steps array<struct<step_idx int, `uses` string, uses_text string, uses_breaks boolean, run string, "
    "with_is_map boolean, with_params map<string,string>>>>>"
)


def parse(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project `df` to exactly the columns of `ddl`; columns it lacks become NULL."""
    have = set(df.columns)

    def column(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`") if field.name in have else F.lit(None)
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in parse(ddl).fields])
