"""Dependency audits, scores, history, reports, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsift.functions import severity as sev
from fleetsift.functions import text
from fleetsift.operators import deps, history, ingest, report, scoring
from fleetsift.plans.session import working_directory
from fleetsift.sinks import sarif, tables
from fleetsift.sources import audit_reports
from fleetsift.streaming import continuous, logs, runs
from verification.registry import query

_ORDER = ["item_index", "rule_id", "file_path", "line_number", "finding_type", "rule_severity", "confidence", "attack_vector", "base_score"]


def _scored(t):
    return scoring.score_findings(t.findings)


def _scans(t):
    return t.view("b_scans")


# --- Audit reports -----------------------------------------------------------------

@query("s03_python_audit", """
select scan_id, file_path, package, version, cve_id, case when fix_version is null then '' else concat(fix_version, '|9.9') end as fix_versions,
 concat('d ', package) as description from b_vulns where ecosystem = 'python'""")
def _(t):
    return audit_reports.python_audit(t.python_reports).select(
        "scan_id", "file_path", "package", "version", "cve_id", F.array_join("fix_versions", "|").alias("fix_versions"), "description")


@query("s04_node_audit", """
select scan_id, file_path, package, version, cve_id, case when fix_version is null then '' when ordinal % 2 = 0 then fix_version else 'True' end as fix_versions,
 concat('t ', package) as description from b_vulns where ecosystem = 'node'""")
def _(t):
    return audit_reports.node_audit(t.node_reports).select(
        "scan_id", "file_path", "package", "version", "cve_id", F.array_join("fix_versions", "|").alias("fix_versions"), "description")


@query("s05_cve_feed", """
select cve_id, case when cve_no % 10 = 9 then 0e0 else base_score end as base_score, case when cve_no % 10 = 9 then 'UNKNOWN' else severity end as severity,
 case when cve_no % 10 = 9 then 'UNKNOWN' else attack_vector end as attack_vector, case when cve_no % 10 = 9 then 'UNKNOWN' else 'NONE' end as privileges_required,
 description, concat('https://r/0/', cve_id, '|https://r/1/', cve_id, '|https://r/2/', cve_id, '|https://r/3/', cve_id, '|https://r/4/', cve_id) as refs
from b_nvd_no""")
def _(t):
    return audit_reports.cve_feed(t.cve_responses).select(
        "cve_id", "base_score", "severity", "attack_vector", "privileges_required", "description",
        F.array_join("references", "|").alias("refs"))


@query("e01_union_raw", "select scan_id, case ecosystem when 'python' then 0 else 1 end as source_rank, ecosystem, package, cve_id, version from b_vulns")
def _(t):
    return deps.union_raw(audit_reports.python_audit(t.python_reports), audit_reports.node_audit(t.node_reports)).select(
        "scan_id", "source_rank", "ecosystem", "package", "cve_id", "version")


@query("e02_cve_keys", "select scan_id, package, cve_key as cve_id, count(*) as n from keyed_vulns group by all")
def _(t):
    return deps.with_cve_key(t.raw_vulns).groupBy("scan_id", "package", "cve_id").agg(F.count(F.lit(1)).alias("n"))


_VULN_ORDER = ["source_rank", "file_path", "ordinal", "version", "fix_versions"]


@query("e03_first_per_cve_and_package", "select scan_id, cve_key as cve_id, package, ecosystem, ordinal, version, coalesce(fix_version, '') as fix from first_vulns")
def _(t):
    return deps.first_per_cve_and_package(deps.with_cve_key(t.raw_vulns), _VULN_ORDER).select(
        "scan_id", "cve_id", "package", "ecosystem", "ordinal", "version", F.array_join("fix_versions", "|").alias("fix"))


@query("e04_cve_details", "select scan_id, cve_id, package, base_score, rule_severity, attack_vector from dep_findings")
def _(t):
    unique = deps.first_per_cve_and_package(deps.with_cve_key(t.raw_vulns), _VULN_ORDER)
    return deps.with_cve_details(unique, t.nvd).select("scan_id", "cve_id", "package", "base_score", "rule_severity", "attack_vector")


@query("e05_fix_advice", "select scan_id, cve_id, package, fixed_version, fix_suggestion from dep_findings")
def _(t):
    unique = deps.first_per_cve_and_package(deps.with_cve_key(t.raw_vulns), _VULN_ORDER)
    return deps.with_fix(unique).select("scan_id", "cve_id", "package", "fixed_version", "fix_suggestion")


@query("e06_dependency_findings", """
select scan_id, rule_id, cve_id, package as package_name, version as installed_version, ecosystem, file_path, description, fixed_version from dep_findings""")
def _(t):
    return deps.dependency_findings(t.raw_vulns, t.nvd, _VULN_ORDER).select(
        "scan_id", "rule_id", "cve_id", "package_name", "installed_version", "ecosystem", "file_path", "description", "fixed_version")


def _version_sql(v: str) -> str:
    return f"list_transform(string_split({v}, '.'), lambda x: cast(x as int))"


@query("e07_advisory_matches", f"""
select scan_id, file_path, v.ecosystem, v.package, version, a.cve_id, arg_min(a.fixed, {_version_sql('a.fixed')}) as fixed
from (select distinct scan_id, file_path, ecosystem, package, version from b_vulns) v
join (select distinct * from b_advisories) a on v.ecosystem = a.ecosystem and v.package = a.package
where {_version_sql('a.introduced')} <= {_version_sql('v.version')} and {_version_sql('v.version')} < {_version_sql('a.fixed')}
group by scan_id, file_path, v.ecosystem, v.package, version, a.cve_id""")
def _(t):
    return deps.match_advisories(t.view("b_vulns"), t.view("b_advisories"))


@query("e07_declared_dependencies", """
select distinct scan_id, concat('d', cast(ordinal as varchar), '/', file_path) as file_path, ecosystem, package, version from b_vulns""")
def _(t):
    one = t.view("b_vulns").selectExpr(
        "scan_id", "concat('d', cast(ordinal as string), '/', file_path) as path",
        "case ecosystem when 'python' then concat('# comment', chr(10), package, ' == ', version, '  # why', chr(10), 'other>=1') "
        "else concat('{\"name\":\"x\",\"dependencies\":{\"', package, '\":\"^', version, '\"}}') end as content")
    return deps.declared_dependencies(one).distinct()


# Specifiers made of the versions `1.a.b`, seven forms for each ecosystem; every third entry of package.json is in another section.
_SPECIFIERS = """
select *, case when ecosystem = 'python' then 'runtime' else case ordinal % 3 when 0 then 'runtime' when 1 then 'development' else 'optional' end end as scope,
 case when ecosystem = 'python' then case ordinal % 7 when 0 then concat('>=', version, ', !=', version) when 1 then concat('~= ', version) when 2 then concat('==', version)
   when 3 then concat('<', version) when 4 then concat('==1.', a, '.*') when 5 then '' else '@ https://x/y.zip' end
  else case ordinal % 7 when 0 then concat('^', version) when 1 then concat('~', version) when 2 then version
   when 3 then concat('>= ', version, ' <1.', cast(cast(a as int) + 2 as string), '.0 || ^2') when 4 then concat('1.', a, '.x') when 5 then '*' else 'latest' end end as specifier
from (select *, regexp_extract(version, '^1[.]([0-9]+)', 1) as a from b_vulns)"""
_ALLOWED = f"""
select *, case when ecosystem = 'python' and f = 0 then [v || [1]] when f = 3 and ecosystem = 'python' or f = 5 then [[0]] when f = 3 then [v, [2, 0, 0]]
  when f = 4 then [[1, m, 0]] when f < 3 then [v] else null end as lows,
 case when ecosystem = 'python' and f = 0 or f = 5 then [[999999]] when f = 0 then [[2, 0, 0]] when f = 1 or f = 4 then [[1, m + 1, 0]] when f = 2 then [v || [1]]
  when f = 3 and ecosystem = 'python' then [v] when f = 3 then [[1, m + 2, 0], [3, 0, 0]] else null end as highs
from (select *, ordinal % 7 as f, cast(a as int) as m, {_version_sql('version')} as v from ({_SPECIFIERS}))"""


def _manifests(t):
    """One manifest per entry, as text."""
    t.view("b_vulns").createOrReplaceTempView("b_vulns")
    return t.spark.sql(_SPECIFIERS).selectExpr(
        "scan_id", "concat('d', cast(ordinal as string), '/', file_path) as path",
        """case ecosystem when 'python' then concat('# first', chr(10), '-r other.txt', chr(10), package, '[x] ', specifier, ' ; python_version > "3"  # why')
         else concat('{"name":"x","', case scope when 'runtime' then 'dependencies' when 'development' then 'devDependencies' else 'optionalDependencies' end,
         '":{"', package, '":"', specifier, '"}}') end as content""")


@query("e07_declared_specifiers", f"""
select scan_id, concat('d', cast(ordinal as varchar), '/', file_path) as file_path, ecosystem, package, scope, specifier from ({_SPECIFIERS})""")
def _(t):
    return deps.declared_specifiers(_manifests(t))


@query("e07_specifier_matches", f"""
select scan_id, concat('d', cast(ordinal as varchar), '/', file_path) as file_path, v.ecosystem, v.package, scope, specifier, a.cve_id, f <> 2 as is_range,
 bool_or(length(lows) = 1 and a.low <= lows[1] and highs[1] <= a.high) as certain, arg_min(a.fixed, a.high) as fixed
from ({_ALLOWED}) v
join (select distinct *, {_version_sql('introduced')} as low, {_version_sql('fixed')} as high from b_advisories) a on v.ecosystem = a.ecosystem and v.package = a.package
where f < 6 and (lows[1] < a.high and a.low < highs[1] or length(lows) = 2 and lows[2] < a.high and a.low < highs[2])
group by scan_id, ordinal, file_path, v.ecosystem, v.package, scope, specifier, a.cve_id, f""")
def _(t):
    return deps.match_specifiers(deps.declared_specifiers(_manifests(t)), t.view("b_advisories"))


@query("e07_unmatched_specifiers", f"""
select scan_id, concat('d', cast(ordinal as varchar), '/', file_path) as file_path, ecosystem, package, scope, specifier from ({_SPECIFIERS}) where ordinal % 7 = 6""")
def _(t):
    return deps.unmatched_specifiers(deps.declared_specifiers(_manifests(t)))


@query("k05_upserted_cves", """
select cve_id, base_score, severity, fetched from (
 select *, row_number() over (partition by cve_id order by fetched desc) as rn from (
  select cve_id, base_score, severity, 1 as fetched from b_nvd union all
  select concat('CVE-2024-', lpad(cast(p_partkey + 60 as varchar), 5, '0')), 9.9e0, 'CRITICAL', 2 from part where p_partkey % 2 = 0)) where rn = 1""")
def _(t):
    old = t.nvd.withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    new = t.table("part").filter("p_partkey % 2 = 0").selectExpr(
        "concat('CVE-2024-', lpad(cast(p_partkey + 60 as string), 5, '0')) as cve_id", "9.9D as base_score", "'CRITICAL' as severity",
        "'LOCAL' as attack_vector", "'' as privileges_required", "'' as description", "array('') as references",
        "timestamp'2024-02-01' as fetched_at")
    return deps.upsert_cves(old, new.select(*old.columns)).select(
        "cve_id", "base_score", "severity", F.month("fetched_at").alias("fetched"))


@query("s10_cve_lookup", """
select k.cve_id, n.cve_id is not null as hit, n.base_score, n.severity
from (select distinct cve_id from b_vulns where cve_id like 'CVE-%') k left join b_nvd n using (cve_id)""")
def _(t):
    ids = t.view("b_vulns").filter("cve_id like 'CVE-%'").select("cve_id").distinct()
    return deps.lookup_cves(ids, t.nvd).select("cve_id", "hit", "base_score", "severity")


# --- Scores -------------------------------------------------------------------------

def _score_query(name, finding_type):
    @query(name, f"""
select scan_id, seq as item_index, file_path, rule_severity, exploitability, blast_radius, trigger_context, risk_score as total from scored
where finding_type = '{finding_type}'""")
    def _(t):
        return _scored(t).filter(F.col("finding_type") == finding_type).select(
            "scan_id", "item_index", "file_path", "rule_severity", "breakdown.*")


_score_query("r01_secret_scores", "secret")
_score_query("r02_misconfig_scores", "misconfig")
_score_query("r03_dependency_scores", "dependency")


@query("r04_dispatched_scores", """
select scan_id, seq as item_index, case when seq = 7 then 'other' else finding_type end as finding_type, case when seq = 7 then 5e0 else risk_score end as risk_score from scored""")
def _(t):
    mixed = t.findings.withColumn("finding_type", F.when(F.col("item_index") == 7, "other").otherwise(F.col("finding_type")))
    return scoring.score_findings(mixed).select("scan_id", "item_index", "finding_type", "risk_score")


@query("r05_overwritten_severities", "select finding_type, rule_severity, severity, count(*) as n from scored group by all")
def _(t):
    return _scored(t).groupBy("finding_type", "rule_severity", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("r06_breakdown_totals", """
select finding_type, exploitability, blast_radius, trigger_context, risk_score as total, count(*) as n from scored group by all""")
def _(t):
    return _scored(t).groupBy("finding_type", "breakdown").agg(F.count(F.lit(1)).alias("n")).select("finding_type", "breakdown.*", "n")


@query("r07_sorted_findings", "select scan_id, seq as item_index, rule_id, file_path, risk_score, severity from scored order by scan_id, risk_score desc, seq")
def _(t):
    return scoring.sort_by_risk(_scored(t), _ORDER).select("scan_id", "item_index", "rule_id", "file_path", "risk_score", "severity")


# --- History --------------------------------------------------------------------------

@query("s08_last_scans", """
select repo_url, scan_id, rn as position from (select *, row_number() over (partition by repo_url order by scan_id desc) as rn from b_scans) where rn <= 10""")
def _(t):
    return history.last_scans(_scans(t)).select("repo_url", "scan_id", "position")


@query("j01_previous_scans", "select repo_url, scan_id, prev_scan_id from links")
def _(t):
    return history.previous_scans(_scans(t), ranges=16)


@query("s09_previous_keys", "select scan_id, rule_id || '|' || file_path as key from before_keys")
def _(t):
    keys = history.distinct_keys(t.findings)
    return history.previous_keys(keys, history.previous_scans(_scans(t))).select("scan_id", history.finding_key().alias("key"))


@query("j02_finding_status", """
select f.scan_id, f.seq as item_index, f.rule_id, f.file_path, case when b.scan_id is null then 'new' else 'persisting' end as status
from b_findings f left join before_keys b on f.scan_id = b.scan_id and f.rule_id = b.rule_id and f.file_path = b.file_path""")
def _(t):
    statuses = history.history_key_statuses(t.findings, _scans(t))
    return history.with_status(t.findings, statuses).select("scan_id", "item_index", "rule_id", "file_path", "status")


@query("j03_fixed_findings", """
select scan_id, rule_id, file_path, 'fixed' as status from (select * from before_keys except select * from now_keys)""")
def _(t):
    return history.fixed_findings(history.history_key_statuses(t.findings, _scans(t)))


@query("u03_persisting_keys", "select * from before_keys intersect select * from now_keys")
def _(t):
    keys = history.distinct_keys(t.findings)
    before = history.previous_keys(keys, history.previous_scans(_scans(t)))
    return keys.join(before, history.KEY, "left_semi")


_COUNTS_SQL = """count(*) as total_count, count_if(severity = 'CRITICAL')::bigint as critical, count_if(severity = 'HIGH')::bigint as high,
 count_if(severity = 'MEDIUM')::bigint as medium, count_if(severity = 'LOW')::bigint as low"""


@query("k03_scan_summaries", f"""
select s.scan_id, s.repo_url, strftime(s.scanned_at, '%Y-%m-%dT%H:%M:%S') as scanned_at, coalesce(total_count, 0) as total_count, coalesce(critical, 0) as critical,
 coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(low, 0) as low
from b_scans s left join (select scan_id, {_COUNTS_SQL} from scored group by scan_id) c using (scan_id)""")
def _(t):
    # Through the table: written as one batch and read back.
    path = working_directory(t.spark, "scans")
    tables.append_scans(history.scan_summaries(_scans(t), _scored(t)), path, 1)
    return t.spark.read.parquet(path).withColumn("scanned_at", F.date_format("scanned_at", "yyyy-MM-dd'T'HH:mm:ss")).select(
        "scan_id", "repo_url", "scanned_at", "total_count", "critical", "high", "medium", "low")


@query("k04_finding_history", """
select f.scan_id, f.file_path, f.line_number, f.finding_type, f.rule_id, f.severity, f.risk_score,
 case when b.scan_id is null then 'new' else 'persisting' end as status, strftime(s.scanned_at, '%Y-%m-%d') as scan_date
from scored f join b_scans s using (scan_id) left join before_keys b on f.scan_id = b.scan_id and f.rule_id = b.rule_id and f.file_path = b.file_path
union all
select x.scan_id, x.file_path, null, null, x.rule_id, null, null, 'fixed', strftime(s.scanned_at, '%Y-%m-%d')
from (select * from before_keys except select * from now_keys) x join b_scans s using (scan_id)""")
def _(t):
    rows = history.history_rows(_scored(t), _scans(t))
    return rows.join(_scans(t).select("scan_id", F.date_format("scanned_at", "yyyy-MM-dd").alias("scan_date")), "scan_id").select(
        "scan_id", "file_path", "line_number", "finding_type", "rule_id", "severity", "risk_score", "status", "scan_date")


@query("a09_critical_trend", """
select repo_url, string_agg(strftime(scanned_at, '%Y-%m-%d') || '=' || cast(critical as varchar), ',' order by scan_id desc) as trend from (
 select s.repo_url, s.scan_id, s.scanned_at, coalesce(c.critical, 0) as critical, row_number() over (partition by s.repo_url order by s.scan_id desc) as rn
 from b_scans s left join (select scan_id, count_if(severity = 'CRITICAL')::bigint as critical from scored group by scan_id) c using (scan_id)
 where s.scan_id not in (select max(scan_id) from b_scans group by repo_url)) where rn <= 10 group by repo_url""")
def _(t):
    summaries = history.scan_summaries(_scans(t), _scored(t))
    current = _scans(t).groupBy("repo_url").agg(F.max("scan_id").alias("scan_id"))
    return history.critical_trend(summaries, current).select("repo_url", F.array_join(F.transform(
        "trend", lambda s: F.concat(F.date_format(s["scanned_at"], "yyyy-MM-dd"), F.lit("="), s["critical"].cast("string"))), ",").alias("trend"))


# --- Counts, gates, report rows ----------------------------------------------------------

@query("a01_severity_counts", f"select scan_id, {_COUNTS_SQL} from scored group by scan_id")
def _(t):
    return report.severity_counts(_scored(t))


@query("a02_type_counts", """
select scan_id, count_if(finding_type = 'secret')::bigint as secret, count_if(finding_type = 'misconfig')::bigint as misconfig,
 count_if(finding_type = 'dependency')::bigint as dependency from scored group by scan_id""")
def _(t):
    return report.type_counts(_scored(t))


@query("a03_repository_totals", f"select repo_url, {_COUNTS_SQL} from scored join b_scans using (scan_id) group by repo_url")
def _(t):
    named = _scored(t).drop("repo_url").join(_scans(t).select("scan_id", "repo_url"), "scan_id")
    return report.severity_counts(named, by=["repo_url"])


_RISK_ORDER_SQL = ("risk_score desc, seq, rule_id, file_path, line_number, finding_type, rule_severity, confidence, attack_vector, base_score")


@query("a04_rule_definitions", f"""
select scan_id, rule_id, replace(rule_name, ' ', '') as name, rule_name as short_description, description as full_description,
 case severity when 'CRITICAL' then 'error' when 'HIGH' then 'error' when 'MEDIUM' then 'warning' else 'note' end as level,
 concat('https://github.com/advisories?query=', rule_id) as help_uri
from (select *, row_number() over (partition by scan_id, rule_id order by {_RISK_ORDER_SQL}) as rn from scored) where rn = 1""")
def _(t):
    return report.rule_definitions(_scored(t), _ORDER).drop("first_seen")


@query("a05_gate", """
select s.scan_id, coalesce(reached, false) as failed, case when s.scan_id % 50 = 0 then 2 when coalesce(reached, false) then 1 else 0 end as exit_code
from b_scans s left join (select scan_id, bool_or(severity in ('CRITICAL', 'HIGH')) as reached from scored group by scan_id) r using (scan_id)""")
def _(t):
    scans = _scans(t).withColumn("error", F.when(F.col("scan_id") % 50 == 0, "clone failed"))
    return report.gate(scans, _scored(t), "high")


@query("a06_verdicts", """
select s.scan_id, case when coalesce(c, 0) > 0 then 'FAIL' when coalesce(h, 0) > 0 then 'WARNING' else 'PASS' end as verdict
from b_scans s left join (select scan_id, count_if(severity = 'CRITICAL') as c, count_if(severity = 'HIGH') as h from scored group by scan_id) r using (scan_id)""")
def _(t):
    return report.verdicts(_scans(t), _scored(t))


@query("p12_findings_of_type", "select scan_id, seq as item_index, rule_id, file_path from scored where finding_type = 'misconfig'")
def _(t):
    return report.of_type(_scored(t), "misconfig").select("scan_id", "item_index", "rule_id", "file_path")


@query("p13_searched_findings", """
select scan_id, seq as item_index, rule_id, file_path from scored where contains(lower(rule_name || ' ' || file_path || ' ' || description), 'rule-3 in svc')""")
def _(t):
    return report.search(_scored(t), "Rule-3 IN svc").select("scan_id", "item_index", "rule_id", "file_path")


@query("p14_summary_rows", """
select scan_id, severity, round(risk_score, 1) as score, finding_type, rule_id, file_path, substr(description, 1, 80) as description from scored""")
def _(t):
    return report.summary_rows(_scored(t))


@query("p15_at_or_above", """
select threshold, scan_id, count(*) as n from scored, (values ('CRITICAL', 0), ('medium', 2), ('none', 1)) t(threshold, rank)
where case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end <= rank group by all""")
def _(t):
    scored = _scored(t)
    out = None
    for threshold in ("CRITICAL", "medium", "none"):
        part = report.at_or_above(scored, threshold).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")).withColumn("threshold", F.lit(threshold))
        out = part if out is None else out.unionByName(part)
    return out.select("threshold", "scan_id", "n")


@query("o02_top_findings", f"""
select scan_id % 40 as scan_id, position, risk_score, seq as item_index, more from (
 select *, row_number() over (partition by scan_id % 40 order by {_RISK_ORDER_SQL}) as position,
  greatest(count(*) over (partition by scan_id % 40) - 50, 0) as more from scored) where position <= 50""")
def _(t):
    grouped = _scored(t).withColumn("scan_id", F.col("scan_id") % 40)
    return report.top_findings(grouped, order=_ORDER).select("scan_id", "position", "risk_score", "item_index", "more")


@query("o04_newest_first", "select scan_id, repo_url, strftime(scanned_at, '%Y-%m-%d %H:%M:%S') as started from b_scans order by started desc, scan_id desc")
def _(t):
    started = _scans(t).withColumn("started", F.date_format("scanned_at", "yyyy-MM-dd HH:mm:ss"))
    return report.newest_first(started).select("scan_id", "repo_url", "started")


@query("o05_newest_reports", """
select report_scan as scan_id, ext, path from (select *, row_number() over (partition by report_scan, ext order by scanned_at desc, path desc) as rn from b_reports) where rn = 1""")
def _(t):
    reports = t.view("b_reports").selectExpr("report_scan as scan_id", "ext", "path", "scanned_at as mtime")
    return report.newest_reports(reports)


@query("u01_bag_union", "select finding_type, rule_id, count(*) as n from scored group by all")
def _(t):
    scored = _scored(t)
    parts = [scored.filter(F.col("finding_type") == kind) for kind in ("secret", "misconfig", "dependency")]
    return scoring.union_findings(*parts).groupBy("finding_type", "rule_id").agg(F.count(F.lit(1)).alias("n"))


# --- Report files ----------------------------------------------------------------------------

_LEVEL_SQL = "case severity when 'CRITICAL' then 'error' when 'HIGH' then 'error' when 'MEDIUM' then 'warning' else 'note' end"
_RESULT_SQL = f"""concat('{{"ruleId":"', rule_id, '","level":"', {_LEVEL_SQL}, '","message":{{"text":"', description,
 '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"', file_path, '","uriBaseId":"%SRCROOT%"}},"region":{{"startLine":', cast(line_number as varchar),
 ',"startColumn":1}}}}}}],"properties":{{"severity":"', severity, '","riskScore":', cast(risk_score as varchar), ',"findingType":"', finding_type, '"}}}}')"""
_RULE_SQL = f"""concat('{{"id":"', rule_id, '","name":"', replace(rule_name, ' ', ''), '","shortDescription":{{"text":"', rule_name, '"}},"fullDescription":{{"text":"', description,
 '"}},"defaultConfiguration":{{"level":"', {_LEVEL_SQL}, '"}},"helpUri":"https://github.com/advisories?query=', rule_id, '"}}')"""


@query("k01_sarif_results", f"select scan_id, {_RESULT_SQL} as result from scored")
def _(t):
    return sarif.results_json(_scored(t))


@query("k02_sarif_documents", f"""
with listed as (select *, row_number() over (partition by scan_id, rule_id order by {_RISK_ORDER_SQL}) as rn from scored),
bodies as (select scan_id, count(*) as n, string_agg({_RESULT_SQL}, ',' order by {_RISK_ORDER_SQL}) as results,
  string_agg(case when rn = 1 then {_RULE_SQL} end, ',' order by {_RISK_ORDER_SQL}) as rules from listed group by scan_id)
select s.scan_id, 0 as part, 1 as parts, concat('{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"fleetsift","version":"0.1.0",',
 '"informationUri":"https://example.com/fleetsift","rules":[', coalesce(rules, ''), ']}}}},"originalUriBaseIds":{{"%SRCROOT%":{{"uri":"', s.repo_url, '/blob/HEAD/"}}}},"results":[', coalesce(results, ''),
 '],"properties":{{"scannedAt":"', strftime(s.scanned_at, '%Y-%m-%dT%H:%M:%S.%f'), 'Z","repoUrl":"', s.repo_url, '","totalFindings":', cast(coalesce(n, 0) as varchar), '}}}}]}}') as document
from b_scans s left join bodies b using (scan_id)""")
def _(t):
    return sarif.documents(_scored(t), _scans(t), order=_ORDER)


@query("k02_sarif_document_lines", f"""
with listed as (select *, row_number() over (partition by scan_id, rule_id order by {_RISK_ORDER_SQL}) as rn from scored),
bodies as (select scan_id, count(*) as n, string_agg({_RESULT_SQL}, ',' order by {_RISK_ORDER_SQL}) as results,
  string_agg(case when rn = 1 then {_RULE_SQL} end, ',' order by {_RISK_ORDER_SQL}) as rules from listed group by scan_id)
select s.scan_id, concat('{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"fleetsift","version":"0.1.0",',
 '"informationUri":"https://example.com/fleetsift","rules":[', coalesce(rules, ''), ']}}}},"originalUriBaseIds":{{"%SRCROOT%":{{"uri":"', s.repo_url, '/blob/HEAD/"}}}},"results":[', coalesce(results, ''),
 '],"properties":{{"scannedAt":"', strftime(s.scanned_at, '%Y-%m-%dT%H:%M:%S.%f'), 'Z","repoUrl":"', s.repo_url, '","totalFindings":', cast(coalesce(n, 0) as varchar), '}}}}]}}') as document
from b_scans s left join bodies b using (scan_id)""")
def _(t):
    # The lines of a scan, put together again: what a reader of the files does.
    lines = sarif.document_lines(_scored(t), _scans(t), order=_ORDER)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("section", "line_no", "line"))), lambda x: x["line"])
    return lines.groupBy("scan_id").agg(F.array_join(parts, "").alias("document"))


@query("k02_sarif_split_documents", """
select scan_id % 40 as scan_id, count(*) as results, count(*) as total from scored group by 1""")
def _(t):
    # Few, large scans and a low limit: every scan needs several documents.
    shape = "runs array<struct<results:array<struct<ruleId:string>>,properties:struct<totalFindings:bigint>>>"
    scored = _scored(t).withColumn("scan_id", F.col("scan_id") % 40)
    scans = _scans(t).filter("scan_id < 40").select("scan_id", "repo_url", "scanned_at").unionByName(
        _scans(t).groupBy((F.col("scan_id") % 40).alias("scan_id")).agg(F.min("repo_url").alias("repo_url"), F.min("scanned_at").alias("scanned_at")))
    one_each = scans.groupBy("scan_id").agg(F.min("repo_url").alias("repo_url"), F.min("scanned_at").alias("scanned_at"))
    docs = sarif.documents(scored, one_each, order=_ORDER, results_per_document=100)
    run = F.from_json("document", shape)["runs"][0]
    return docs.select("scan_id", run.alias("run")).groupBy("scan_id").agg(
        F.sum(F.size("run.results")).alias("results"), F.max("run.properties.totalFindings").alias("total"))


@query("k06_report_paths", """
select scan_id, concat('audit_', regexp_extract(repo_url, '[^/]*$'), '_', strftime(scanned_at, '%Y%m%d_%H%M%S'), '.', case when scan_id % 2 = 0 then 'html' else 'sarif' end) as path from b_scans""")
def _(t):
    _, name = ingest.owner_and_name(F.col("repo_url"))
    ext = F.when(F.col("scan_id") % 2 == 0, "html").otherwise("sarif")
    return _scans(t).select("scan_id", report.report_path(name, F.col("scanned_at"), ext).alias("path"))


# --- Scalar functions ---------------------------------------------------------------------------

@query("f01_f02_severity_maps", """
select severity, case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end as rank,
 case severity when 'CRITICAL' then 'error' when 'HIGH' then 'error' when 'MEDIUM' then 'warning' when 'LOW' then 'note' else 'warning' end as level, count(*) as n
from (select case when seq = 5 then 'odd' else severity end as severity from scored) group by all""")
def _(t):
    severity = F.when(F.col("item_index") == 5, "odd").otherwise(F.col("severity"))
    return (_scored(t).select(severity.alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
            .select("severity", sev.severity_rank(F.col("severity")).alias("rank"), sev.sarif_level(F.col("severity")).alias("level"), "n"))


@query("f04_f05_places", """
select scan_id, seq as item_index, replace(replace(file_path, '/', chr(92)), chr(92), '/') as uri, coalesce(nullif(line_number % 3, 0), 1) as line from b_findings""")
def _(t):
    windows = F.replace("file_path", F.lit("/"), F.lit("\\"))
    return t.findings.select("scan_id", "item_index", text.slashes(windows).alias("uri"), sarif.line_or_first(F.col("line_number") % 3).alias("line"))


@query("f06_f10_f16_scan_labels", """
select scan_id, repo_url || '/blob/HEAD/' as root, regexp_extract(repo_url, '[^/]*$') as short_name,
 case when scan_id % 4 in (0, 1) then 'done' else 'error' end as status, strftime(scanned_at, '%Y-%m-%d %H:%M:%S') as shown from b_scans""")
def _(t):
    return _scans(t).select(
        "scan_id", sarif.source_root(F.col("repo_url")).alias("root"), ingest.short_name(F.col("repo_url")).alias("short_name"),
        report.scan_status((F.col("scan_id") % 4).cast("int")).alias("status"), F.date_format("scanned_at", "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("f07_f15_references", """
select scan_id, cve_id, concat('https://github.com/advisories?query=', coalesce(nullif(case when package like '%1' then 'GHSA-x' else '' end, ''), cve_id)) as url from dep_findings""")
def _(t):
    found = deps.dependency_findings(t.raw_vulns, t.nvd, _VULN_ORDER)
    named = found.withColumn("cve_reference", F.when(F.col("package_name").endswith("1"), "GHSA-x").otherwise(""))
    return named.select("scan_id", "cve_id", report.advisory_url(sarif.reference_of()).alias("url"))


@query("f08_f09_keys_and_bars", "select scan_id, seq as item_index, rule_id || '|' || file_path as key, cast(trunc(risk_score / 10e0 * 100e0) as int) as percent from scored")
def _(t):
    return _scored(t).select("scan_id", "item_index", history.finding_key().alias("key"), report.score_bar_percent(F.col("risk_score")).alias("percent"))


# --- Logs -------------------------------------------------------------------------------------------

@query("t04_clean_lines", "select scan_id, line_no, line from clean_logs")
def _(t):
    return logs.clean_lines(t.view("b_logs")).select("scan_id", "line_no", "line")


@query("f12_summary_lines", "select scan_id, line_no, critical, high, medium, low from log_counts where critical is not null")
def _(t):
    found = logs.clean_lines(t.view("b_logs")).withColumn("s", logs.summary_of(F.col("line"))).filter("s is not null")
    return found.select("scan_id", "line_no", "s.*")


@query("f13_line_classes", """
select line, case when regexp_matches(line, '(?i)phase') then 'log-phase' when regexp_matches(line, '(?i)ok|complete|pass|found') then 'log-ok'
 when regexp_matches(line, '(?i)warn|high|critical') then 'log-warn' when regexp_matches(line, '(?i)error|fail|x ') then 'log-err' else '' end as class, count(*) as n
from b_logs group by all""")
def _(t):
    return t.view("b_logs").groupBy("line").agg(F.count(F.lit(1)).alias("n")).select("line", logs.line_class(F.col("line")).alias("class"), "n")


@query("t01_streamed_lines", "select scan_id, line_no, line from clean_logs")
def _(t):
    base = working_directory(t.spark, "lines")
    runs.deliver_lines(logs.clean_lines(t.stream("b_logs")), f"{base}/lines", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/lines").select("scan_id", "line_no", "line")


@query("t02_streamed_summaries", "select * from log_summary")
def _(t):
    base = working_directory(t.spark, "summaries")
    runs.keep_snapshot(logs.log_stats(t.stream("b_logs")), f"{base}/stats", f"{base}/checkpoint")
    return runs.latest_snapshot(t.spark, f"{base}/stats", ["scan_id"])


@query("t02_batch_summaries", "select * from log_summary")
def _(t):
    return logs.log_stats(t.view("b_logs"))


@query("t03_status_snapshots", """
select scan_id, log_count, critical, high, medium, low, case when scan_id % 7 = 0 then 'running' when scan_id % 4 in (0, 1) then 'done' else 'error' end as status, r.path as report
from log_summary left join (select report_scan, path from (select *, row_number() over (partition by report_scan, ext order by scanned_at desc, path desc) as rn from b_reports) where rn = 1 and ext = 'html') r
 on scan_id = r.report_scan""")
def _(t):
    base = working_directory(t.spark, "status")
    runs.keep_snapshot(logs.log_stats(t.stream("b_logs")), f"{base}/stats", f"{base}/checkpoint")
    stats = runs.latest_snapshot(t.spark, f"{base}/stats", ["scan_id"])
    exits = t.table("events").select(F.col("user_id").alias("scan_id")).distinct().filter("scan_id % 7 <> 0").withColumn("exit_code", (F.col("scan_id") % 4).cast("int"))
    newest = report.newest_reports(t.view("b_reports").selectExpr("report_scan as scan_id", "ext", "path", "scanned_at as mtime"))
    return logs.status_snapshots(stats, exits, newest.filter("ext = 'html'").select("scan_id", F.col("path").alias("report")))


@query("t05_late_findings", """
select f.scan_id, f.file_path, f.line_number, f.finding_type, f.rule_id, f.severity, f.risk_score,
 case when b.scan_id is null then 'new' else 'persisting' end as status
from scored f left join before_keys b on f.scan_id = b.scan_id and f.rule_id = b.rule_id and f.file_path = b.file_path
union all select scan_id, file_path, null, null, rule_id, null, null, 'fixed' from (select * from before_keys except select * from now_keys)""")
def _(t):
    # Three micro-batches: most findings of even scans, those of odd ones, and what comes late for either.
    # Even scans are finished first, so each odd one comes between two that are closed.
    base = working_directory(t.spark, "late")
    scored, scans = _scored(t), _scans(t).select("scan_id", "repo_url", "scanned_at")
    scored = scored.withColumn("arrives", F.when(F.pmod(F.xxhash64("item_index", "rule_id"), F.lit(5)) == 0, 2).otherwise(F.pmod("scan_id", F.lit(2))).cast("int"))
    scored.write.partitionBy("arrives").parquet(f"{base}/findings")
    finished = [scans.filter("scan_id % 2 = 0"), scans, scans]
    tables_ = continuous.AuditTables(f"{base}/out")
    stored = t.spark.read.parquet(f"{base}/findings")
    for batch, done in enumerate(finished):
        stored.filter(F.col("arrives") == batch).drop("arrives").write.mode("append").parquet(f"{base}/stream")
        stream = t.spark.readStream.schema(stored.drop("arrives").schema).parquet(f"{base}/stream")
        continuous.continuous_history(stream, tables_, f"{base}/checkpoint", lambda done=done: done)
    return continuous.current_history(t.spark, tables_).drop("description", "fix_snippet")


@query("t05_late_summaries", """
select scan_id, repo_url, strftime(scanned_at, '%Y-%m-%d') as scanned, coalesce(total_count, 0) as total_count, coalesce(critical, 0) as critical
from (select scan_id, repo_url, scanned_at from b_scans) s left join (select scan_id, count(*) as total_count, count(*) filter (where severity = 'CRITICAL') as critical from scored group by 1) c using (scan_id)""")
def _(t):
    base = working_directory(t.spark, "summaries")
    scored, scans = _scored(t), _scans(t).select("scan_id", "repo_url", "scanned_at")
    tables_ = continuous.AuditTables(f"{base}/out")
    for batch, part in enumerate(("line_number % 3 > 0", "line_number % 3 = 0 or line_number is null")):
        scored.filter(part).write.mode("append").parquet(f"{base}/stream")
        stream = t.spark.readStream.schema(scored.schema).parquet(f"{base}/stream")
        continuous.continuous_history(stream, tables_, f"{base}/checkpoint", lambda: scans)
    return continuous.current_scans(t.spark, tables_).select("scan_id", "repo_url", F.date_format("scanned_at", "yyyy-MM-dd").alias("scanned"), "total_count", "critical")
