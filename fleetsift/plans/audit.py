"""The whole audit of a fleet as one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsift.operators import deps, history, ingest, misconfig, report, scoring, secrets
from fleetsift.operators.misconfig import RULES, Rule
from fleetsift.schemas import FINDING_HISTORY, FINDINGS, SCANS, conform
from fleetsift.sinks import sarif, tables
from fleetsift.sources.secret_rules import BUILT_IN, SecretRule


def scan_files(files: DataFrame, *, requests: DataFrame | None = None, raw_dependencies: DataFrame | None = None,
               cve_feed: DataFrame | None = None, advisories: DataFrame | None = None, extra_findings: DataFrame | None = None,
               secret_rules: Sequence[SecretRule] = BUILT_IN, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of all scanners over `repo_files`, not yet scored.

    `requests` switches scanners off per scan.  `raw_dependencies` are the
    flattened dependency audits, `extra_findings` imported static-analysis
    findings.  With `advisories`, the specifiers in the files' own manifests are held against
    them; what the audits report too is not listed twice.
    """
    def wanted(scanner: str) -> DataFrame:
        return files if requests is None else ingest.files_to_scan(files, requests, scanner)

    parts = [secrets.secret_findings(wanted("secret"), secret_rules),
             misconfig.misconfig_findings(wanted("misconfig"), rules)]
    others = []
    if extra_findings is not None:
        others.append(conform(extra_findings, FINDINGS))
    if (raw_dependencies is not None or advisories is not None) and cve_feed is None:
        raise ValueError("dependency audits need the CVE table")
    if raw_dependencies is not None:
        others.append(deps.dependency_findings(raw_dependencies, cve_feed))
    if advisories is not None:
        matches = deps.match_specifiers(deps.declared_specifiers(wanted("dependency")), advisories)
        matches = matches if raw_dependencies is None else deps.not_reported(matches, raw_dependencies)
        others.append(deps.dependency_findings(deps.raw_from_specifiers(matches), cve_feed))
    found = scoring.union_findings(*parts, *others)
    return found if requests is None else conform(ingest.drop_skipped_scanners(found, requests), FINDINGS)


def run_audit(files: DataFrame, scans: DataFrame, out: str, batch: int, *, threshold: str = "HIGH", **inputs) -> DataFrame:
    """Scan, score, and add one batch to all tables below `out`; return the gate result per scan.

    `scans` is (scan_id, repo_url, scanned_at, error).  The scored findings are
    written once and read back: everything after reads that table instead of
    scanning again, and a lost executor costs no rescan.  The scans are compared
    with each other and with earlier batches.
    """
    spark = files.sparkSession
    tables.write_batch(scoring.score_findings(scan_files(files, **inputs)), f"{out}/findings", batch)
    scored = spark.read.parquet(f"{out}/findings/batch={batch}")
    good = scans.filter(F.col("error").isNull())
    stored_scans = tables.read_or_empty(spark, f"{out}/scans", SCANS).filter(F.col("batch") < batch)
    stored = tables.read_or_empty(spark, f"{out}/history", FINDING_HISTORY).filter(F.col("batch") < batch)
    tables.append_scans(history.scan_summaries(good, scored), f"{out}/scans", batch)
    tables.append_history(history.history_rows_for_new_scans(scored, good, stored, stored_scans), good, f"{out}/history", batch)
    sarif.write_documents(sarif.document_lines(scored, good), f"{out}/sarif/batch={batch}")
    return report.gate(scans, scored, threshold)
