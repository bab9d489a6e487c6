"""Repository files, secrets, workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsift import fixed_values as V
from fleetsift.functions import text
from fleetsift.operators import ingest, misconfig, report, scoring, secrets, structural, workflows
from fleetsift.plans.session import working_directory
from fleetsift.sources import repo_files, secret_rules
from fleetsift.sources.audit_reports import static_analysis
from fleetsift.streaming import continuous
from verification.inputs import WORKFLOW_NO
from verification.registry import query


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- Sources and file selection -------------------------------------------------

@query("s01_s02_decoded_files", r"""
select scan_id, path, content, cast(strlen(content) + 2 as bigint) as size_bytes from (
 select scan_id, path, concat(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as content, content as raw from b_files
) """.replace("strlen(content) + 2", "octet_length(encode(raw)) + 4"))
def _(t):
    # A Windows line ending and two bytes that are no UTF-8 are added to each file.
    raw = F.concat(F.encode("content", "UTF-8"), F.unhex(F.lit("FFFE0D0A")))
    return repo_files.decode_files(t.files.withColumn("raw", raw).drop("content")).select("scan_id", "path", "content", "size_bytes")


@query("p01_owner_and_name", r"""
select repo_url, case when len(p) < 2 then 'unknown' else p[-2] end as owner,
  case when len(p) < 2 then 'unknown' else replace(p[-1], '.git', '') end as repo_name
from (select repo_url, string_split(rtrim(repo_url, '/'), '/') as p from (
  select case scan_id % 4 when 0 then concat(repo_url, '.github.io/') when 1 then concat(repo_url, '.git') when 2 then concat('x', cast(scan_id as varchar)) else repo_url end as repo_url
  from b_scans))""")
def _(t):
    urls = t.view("b_scans").selectExpr(
        "case scan_id % 4 when 0 then concat(repo_url, '.github.io/') when 1 then concat(repo_url, '.git') "
        "when 2 then concat('x', cast(scan_id as string)) else repo_url end as repo_url")
    return ingest.with_owner_and_name(urls)


@query("p02_unskipped_paths", r"""
select scan_id, path from b_files
where len(list_filter(string_split(path, '/'), lambda c: c in ('.git','node_modules','__pycache__','.venv','venv','.env_dir','vendor','dist','build','.tox','.mypy_cache'))) = 0""")
def _(t):
    return t.files.filter(~ingest.in_skipped_path(F.col("path"))).select("scan_id", "path")


@query("p03_kept_files", "select scan_id, path from kept_files")
def _(t):
    return ingest.select_repo_files(t.files).select("scan_id", "path")


@query("p04_file_types", "select path, ext as suffix, case when ext = '' then name else ext end as file_type from repo_files")
def _(t):
    path = F.col("path")
    return t.files.select("path", F.lower(text.suffix(path)).alias("suffix"), ingest.file_type(path).alias("file_type"))


@query("p05_file_flags", "select scan_id, path, is_workflow, is_env_file, is_dockerfile, is_dependency_manifest from kept_files")
def _(t):
    return ingest.ingest(t.files).select("scan_id", "path", "is_workflow", "is_env_file", "is_dockerfile", "is_dependency_manifest")


@query("p06_flag_views", """
select 'workflow' as view, path from kept_files where is_workflow union all
select 'env', path from kept_files where is_env_file union all
select 'dockerfile', path from kept_files where is_dockerfile union all
select 'manifest', path from kept_files where is_dependency_manifest""")
def _(t):
    files = ingest.ingest(t.files.select("scan_id", "path"))
    views = [("workflow", ingest.workflow_files), ("env", ingest.env_files),
             ("dockerfile", ingest.dockerfiles), ("manifest", ingest.dependency_manifests)]
    out = None
    for name, view in views:
        part = view(files).select(F.lit(name).alias("view"), "path")
        out = part if out is None else out.unionByName(part)
    return out


@query("p07_yaml_files", "select scan_id, path from b_files where path like '%.yml' or path like '%.yaml'")
def _(t):
    return ingest.yaml_files(t.files).select("scan_id", "path")


@query("p08_audited_manifests", """
select path, case when name = 'requirements.txt' then 'python' else 'node' end as ecosystem from repo_files
where name = 'requirements.txt' or (name = 'package.json' and not contains(path, 'node_modules'))""")
def _(t):
    return ingest.auditable_manifests(t.files).select("path", "ecosystem")


_SCANNABLE_SQL = """(ext in ('.yml','.yaml','.env','.json','.sh','.bash','.py','.js','.ts','.rb','.go','.java','.tf','.toml','.ini','.cfg',
  '.conf','.config','.xml','.properties','.secrets','.key','.pem')
  or name in ('.env','.env.local','.env.production','.env.development','.env.staging','.env.test','.env.example','secrets.yml',
  'secrets.yaml','credentials.json','.npmrc','.pypirc','config.yml','config.yaml'))"""


@query("p09_secret_scannable", f"select path from repo_files where {_SCANNABLE_SQL}")
def _(t):
    return t.files.filter(ingest.is_secret_scannable(F.col("path"))).select("path")


@query("p10_validated_requests", """
select scan_id, trim(asked_url) as repo_url, starts_with(trim(asked_url), 'https://github.com/') as accepted from b_requests""")
def _(t):
    asked = t.view("b_requests").drop("repo_url").withColumnRenamed("asked_url", "repo_url")
    return ingest.validated_requests(asked).select("scan_id", "repo_url", "accepted")


@query("p11_unskipped_findings", """
select f.scan_id, f.seq as item_index, f.rule_id, f.file_path, f.finding_type from b_findings f join b_requests r using (scan_id)
where not ((f.finding_type = 'secret' and r.skip_secrets) or (f.finding_type = 'misconfig' and r.skip_misconfigs)
  or (f.finding_type = 'dependency' and r.skip_deps))""")
def _(t):
    return ingest.drop_skipped_scanners(t.findings, t.view("b_requests")).select(
        "scan_id", "item_index", "rule_id", "file_path", "finding_type")


@query("a08_ingest_counts", """
select scan_id, count(*) as files, count_if(is_workflow)::bigint as workflows, count_if(is_env_file)::bigint as env_files, count_if(is_dockerfile)::bigint as dockerfiles
from kept_files group by scan_id""")
def _(t):
    return ingest.ingest_counts(ingest.ingest(t.files))


# --- Secrets ---------------------------------------------------------------------

_LINES_SQL = f"""
select scan_id, path, name, unnest(ls) as line, generate_subscripts(ls, 1) as line_number from (
  select scan_id, path, name, string_split_regex(content, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E]|\\x{{85}}|\\x{{2028}}|\\x{{2029}}') as ls
  from repo_files where {_SCANNABLE_SQL})"""
_RULES_SQL = "(values " + ", ".join(f"({_sql(r[0])}, {_sql(r[1])}, {_sql(r[2])}, {_sql(r[3])})" for r in V.SECRET_RULES) + ") r(rule_id, rule_name, pattern, severity)"
_HIGH_RISK_SQL = """name in ('.env','.env.local','.env.production','.env.development','.env.staging','.env.test','.env.example',
 'secrets.yml','secrets.yaml','credentials.json','.npmrc','.pypirc','config.yml','config.yaml')"""


def _rule_matches_sql(rule: tuple) -> str:
    """Matches of one pattern, which stands as a constant."""
    return (f"select l.scan_id, l.path, l.name, l.line_number, {_sql(rule[0])} as rule_id, {_sql(rule[1])} as rule_name, {_sql(rule[3])} as severity, "
            f"unnest(regexp_extract_all(l.line, {_sql(rule[2])}, 0)) as m from ls l")


@query("d01_secret_findings", f"""
with ls as ({_LINES_SQL}), found as ({' union all '.join(_rule_matches_sql(r) for r in V.SECRET_RULES)})
select scan_id, path as file_path, line_number, rule_id, rule_name, severity as rule_severity, concat(substr(m, 1, 4), '***') as detail,
  case when {_HIGH_RISK_SQL} then 'HIGH' else 'MEDIUM' end as confidence
from found""")
def _(t):
    return secrets.secret_findings(t.files).select(
        "scan_id", "file_path", "line_number", "rule_id", "rule_name", "rule_severity", "detail", "confidence")


def _one_rule(rule: secret_rules.SecretRule, fixed: tuple) -> None:
    @query(f"d_{rule.id.lower()}", f"""
with ls as ({_LINES_SQL})
select scan_id, path, line_number, concat(substr(m, 1, 4), '***') as redacted from ({_rule_matches_sql(fixed)})""")
    def _(t):
        return secrets.match_secrets(t.files, [rule]).select("scan_id", "path", "line_number", "redacted")


for _rule, _fixed in zip(secret_rules.BUILT_IN, V.SECRET_RULES):
    _one_rule(_rule, _fixed)

_USER_RULE = secret_rules.SecretRule("USR001", "Token assignment", r'token = "[0-9a-f]{40}"', "HIGH", "Token in text.")


@query("x01_user_secret_rule", """
select doc_id as scan_id, line_number, concat(substr(m, 1, 4), '***') as redacted from (
 select doc_id, line_number, unnest(regexp_extract_all(line, 'token = "[0-9a-f]{40}"', 0)) as m from (
  select doc_id, unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E]|\\x{85}|\\x{2028}|\\x{2029}')) as line,
   generate_subscripts(string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E]|\\x{85}|\\x{2028}|\\x{2029}'), 1) as line_number from documents))""")
def _(t):
    docs = t.table("documents").selectExpr("'u' as repo_url", "doc_id as scan_id", "concat('d', cast(doc_id as string), '.py') as path", "text as content")
    return secrets.match_secrets(docs, [_USER_RULE]).select("scan_id", "line_number", "redacted")


@query("s07_secret_rules", f"""
with ls as ({_LINES_SQL}), found as ({' union all '.join(_rule_matches_sql(r) for r in V.SECRET_RULES)})
select id, r.name, pattern, r.severity, cast(null as varchar) as cve_reference, count(distinct path) as files from
 (values {', '.join(f"({_sql(r[0])}, {_sql(r[1])}, {_sql(r[2])}, {_sql(r[3])})" for r in V.SECRET_RULES)}) r(id, name, pattern, severity)
 left join found on id = rule_id group by all""")
def _(t):
    # The catalogue, and how many files each rule finds something in.
    files = secrets.match_secrets(t.files).select("rule_id", "path").distinct().groupBy("rule_id").agg(F.count(F.lit(1)).alias("files"))
    rules = secret_rules.secret_rules(t.spark)
    return rules.join(files, rules["id"] == files["rule_id"], "left").select(
        "id", "name", "pattern", "severity", "cve_reference", F.coalesce("files", F.lit(0)).alias("files"))


@query("j05_rule_texts", f"""
with ls as ({_LINES_SQL}), found as ({' union all '.join(_rule_matches_sql(r) for r in V.SECRET_RULES)})
select rule_id, rule_name, severity as rule_severity, count(*) as findings from found group by all""")
def _(t):
    return (secrets.secret_findings(t.files).groupBy("rule_id", "rule_name", "rule_severity")
            .agg(F.count(F.lit(1)).alias("findings")))


_FLEET_SQL = f"""
with ls as ({_LINES_SQL.replace("from repo_files where", "from kept_files where")}),
found as ({' union all '.join(_rule_matches_sql(r) for r in V.SECRET_RULES)}),
points as (select *, case severity when 'CRITICAL' then 4e0 when 'HIGH' then 3e0 when 'MEDIUM' then 2e0 else 1e0 end as p from found),
risks as (select *, least(10e0,
  case when {_HIGH_RISK_SQL} then least(4e0, p + 0.5e0) else p end
  + case when contains(path, '.github/workflows') then 3e0 when starts_with(path, '.env') then 2.5e0 when contains(lower(path), 'docker') then 2e0 else 1e0 end
  + case when contains(path, '.github/workflows') then 3e0 when contains(path, '.env') then 2.5e0 else 1e0 end) as risk_score from points),
banded as (select *, case when risk_score >= 9 then 'CRITICAL' when risk_score >= 7 then 'HIGH' when risk_score >= 4 then 'MEDIUM' else 'LOW' end as band from risks)"""


@query("fleet_secret_counts", _FLEET_SQL + """
select concat('https://github.com/org', cast(scan_id % 7 as varchar), '/repo', cast(scan_id as varchar)) as repo_url, count(*) as total_count,
 count_if(band = 'CRITICAL')::bigint as critical, count_if(band = 'HIGH')::bigint as high, count_if(band = 'MEDIUM')::bigint as medium, count_if(band = 'LOW')::bigint as low
from banded group by scan_id""")
def _(t):
    scored = scoring.score_findings(secrets.secret_findings(ingest.ingest(t.files)))
    return report.severity_counts(scored, by=["repo_url"])


@query("t05_continuous_audit", _FLEET_SQL + """
select scan_id, path as file_path, line_number, rule_id, risk_score, band as severity from banded""")
def _(t):
    base = working_directory(t.spark, "continuous")
    results = continuous.AuditTables(base)
    continuous.continuous_audit(ingest.ingest(t.stream("b_files")), results, f"{base}/checkpoint")
    return t.spark.read.parquet(results.findings).select("scan_id", "file_path", "line_number", "rule_id", "risk_score", "severity")


@query("t05_continuous_history", _FLEET_SQL + """
select s.scan_id, count(distinct case when path is not null then concat(path, rule_id) end) as new_keys, count(path) as findings, coalesce(max(risk_score), 0) as worst, coalesce(count_if(band = 'CRITICAL'), 0)::bigint as critical
from (select distinct scan_id from b_files) s left join banded b using (scan_id) group by s.scan_id""")
def _(t):
    base = working_directory(t.spark, "history")
    results = continuous.AuditTables(base)
    finished = t.files.select("scan_id", "repo_url", F.lit("2024-01-01").cast("timestamp").alias("scanned_at")).distinct()
    continuous.continuous_audit(ingest.ingest(t.stream("b_files")), results, f"{base}/checkpoint", finished=lambda: finished)
    rows = t.spark.read.parquet(results.history).filter("status = 'new'").groupBy("scan_id").agg(
        F.count_distinct("file_path", "rule_id").alias("new_keys"), F.max("risk_score").alias("worst"))
    scans = t.spark.read.parquet(results.scans)
    return scans.join(rows, "scan_id", "left").select(
        "scan_id", F.coalesce("new_keys", F.lit(0)).alias("new_keys"), F.col("total_count").alias("findings"),
        F.coalesce("worst", F.lit(0.0)).alias("worst"), "critical")


# --- Workflow files -----------------------------------------------------------------

@query("w01_parsed_steps", """
select scan_id, path, job_idx, job_name, step_idx, uses, run, with_ref, with_key from b_wsteps""")
def _(t):
    steps = workflows.exploded_steps(workflows.parse_workflows(t.yaml))
    return steps.select("scan_id", "path", "job_idx", "job_name", "step_idx", "uses", "run",
                        F.try_element_at("with_params", F.lit("ref")).alias("with_ref"),
                        F.try_element_at("with_params", F.lit("key")).alias("with_key"))


@query("w01_rejected_files", """
select scan_id, path, case wf % 5 when 1 then 'not YAML' when 2 then 'no mapping' when 3 then 'aliases outgrow the file' else 'odd values' end as reason
from (select distinct scan_id, path, wf from b_wsteps) where wf % 5 > 0""")
def _(t):
    # Files as they are, cut off, lists, with aliases of aliases, with a list as a key.
    wf = f"({WORKFLOW_NO})"
    broken = t.yaml.selectExpr("repo_url", "scan_id", "path", f"""case {wf} % 5 when 0 then content when 1 then concat(content, chr(10), 'x: [1')
      when 2 then concat('- w', {wf}) when 3 then concat('p: &p {{', array_join(transform(sequence(1, 200), k -> concat('k', k, ': v')), ', '), '}}', chr(10),
      's: &s [', array_join(array_repeat('{{with: *p}}', 200), ', '), ']', chr(10), 'jobs: {{', array_join(transform(sequence(1, 200), k -> concat('j', k, ': {{steps: *s}}')), ', '), '}}')
      else concat('on: 2024-13-45', chr(10), 'jobs: {{}}') end as content""")
    return workflows.rejected_workflows(broken).select("scan_id", "path", "reason")


@query("w02_triggers", "select distinct scan_id, path, triggers_csv from b_wsteps")
def _(t):
    return workflows.parse_workflows(t.yaml).select("scan_id", "path", F.array_join("triggers", ",").alias("triggers_csv"))


@query("w03_step_counts", "select scan_id, path, job_name, count(*) as steps, count(uses) as with_uses, count(run) as with_run from b_wsteps group by all")
def _(t):
    return workflows.exploded_steps(workflows.parse_workflows(t.yaml)).groupBy("scan_id", "path", "job_name").agg(
        F.count(F.lit(1)).alias("steps"), F.count("uses").alias("with_uses"), F.count("run").alias("with_run"))


def line_sql(needle: str, content: str = "content") -> str:
    return (f"cast(coalesce(nullif(list_position(list_transform(string_split({content}, chr(10)), lambda l: contains(l, {needle})), true), 0), 1) as bigint)")


@query("w04_line_of", f"select scan_id, path, {line_sql(repr('github.'))} as first_context, {line_sql(repr('uses: actions/cache'))} as first_cache, {line_sql(repr('no such text'))} as missing from b_yaml")
def _(t):
    def at(needle):
        return text.line_of(F.col("content"), F.lit(needle))

    return t.yaml.select("scan_id", "path", at("github.").alias("first_context"), at("uses: actions/cache").alias("first_cache"),
                         at("no such text").alias("missing"))


@query("w04_line_of_documents", """
select doc_id, cast(coalesce(nullif(list_position(list_transform(
  string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E]|\\x{85}|\\x{2028}|\\x{2029}'), lambda l: contains(l, ' the ')), true), 0), 1) as bigint) as line_number from documents""")
def _(t):
    return t.table("documents").select("doc_id", text.line_of(F.col("text"), F.lit(" the ")).alias("line_number"))


_M = ["scan_id", "file_path", "rule_id", "line_number", "rule_severity", "description"]


def _run_rules(t, rules):
    found = misconfig.misconfig_findings(t.yaml, rules)
    return found.select(*_M, F.array_join("affected_triggers", ",").alias("triggers_csv"))


_STEPS = "b_wsteps s join b_yaml y on s.path = y.path"

_M01_FROM = f"""from {_STEPS}, (values {', '.join(f"('{c}')" for c in V.UNTRUSTED_CONTEXTS)}) c(ctx) where contains(s.run, c.ctx)"""
M01 = f"""
select s.scan_id, s.path as file_path, 'CICD-001' as rule_id, {line_sql('c.ctx')} as line_number, 'CRITICAL' as rule_severity,
 concat('Script injection via `', chr(36), '{{{{ ', c.ctx, ' }}}}` in job `', s.job_name, '`. Attackers control this value and can inject shell commands.') as description,
 s.triggers_csv {_M01_FROM}"""
M02 = f"""
select s.scan_id, s.path as file_path, 'CICD-002' as rule_id, {line_sql(repr('pull_request_target'))} as line_number, 'CRITICAL' as rule_severity,
 concat('Workflow uses `pull_request_target` AND checks out PR head code (ref=`', s.with_ref, '`). This gives untrusted fork code access to repository secrets.') as description,
 s.triggers_csv from {_STEPS}
where contains(concat(',', s.triggers_csv, ','), ',pull_request_target,') and contains(s.uses, 'actions/checkout') and (contains(s.with_ref, 'head') or contains(s.with_ref, 'pull_request'))"""
_WF = "(select distinct scan_id, path, wf, triggers_csv, wf_perm_str, n_write_scopes from b_wsteps)"
M03 = f"""
select s.scan_id, s.path as file_path, 'CICD-003' as rule_id, {line_sql(repr('write-all'))} as line_number, 'HIGH' as rule_severity,
 'GITHUB_TOKEN set to `write-all` in workflow level.' as description, s.triggers_csv from {_WF} s join b_yaml y on s.path = y.path where wf_perm_str = 'write-all'
union all
select s.scan_id, s.path, 'CICD-003', {line_sql(repr('permissions'))}, 'MEDIUM',
 concat('GITHUB_TOKEN has write access to ', cast(n_write_scopes as varchar), ' scopes in workflow level: ',
  case n_write_scopes when 4 then 'contents, issues, packages, deployments' else 'contents, issues, packages, deployments, checks' end, '.'), s.triggers_csv
 from {_WF} s join b_yaml y on s.path = y.path where wf_perm_str = '' and n_write_scopes > 3
union all
select s.scan_id, s.path, 'CICD-003', {line_sql(repr('write-all'))}, 'HIGH', 'GITHUB_TOKEN set to `write-all` in job `job1`.', s.triggers_csv
 from {_WF} s join b_yaml y on s.path = y.path where s.wf % 11 = 0"""
_REF = "regexp_extract(s.uses, '[^@]*$')"
_M04_WHERE = f"contains(s.uses, '@') and not regexp_full_match({_REF}, '(?i)[0-9a-f]{{7,40}}')"
_ACTION = f"substr(s.uses, 1, length(s.uses) - length({_REF}) - 1)"
M04 = f"""
select s.scan_id, s.path as file_path, 'CICD-004' as rule_id, {line_sql('s.uses')} as line_number,
 case when {_REF} in ('main', 'master', 'latest') then 'HIGH' else 'MEDIUM' end as rule_severity,
 concat('Action `', {_ACTION}, '` pinned to `', {_REF}, '` (mutable tag/branch). Supply chain attack possible if that action repo is compromised.') as description,
 s.triggers_csv from {_STEPS} where {_M04_WHERE}"""
M05 = f"""
select s.scan_id, s.path as file_path, 'CICD-005' as rule_id, {line_sql(repr('actions/cache'))} as line_number, 'HIGH' as rule_severity,
 'Cache key doesn''t include hashFiles(). Attacker can poison the cache with malicious artifacts.' as description, s.triggers_csv
from {_STEPS} where contains(s.uses, 'actions/cache') and not contains(coalesce(s.with_key, ''), 'hashFiles')"""
M06 = f"""
select scan_id, path as file_path, 'CICD-006' as rule_id, {line_sql(repr('ACTIONS_ALLOW_UNSECURE_COMMANDS'))} as line_number, 'HIGH' as rule_severity,
 'ACTIONS_ALLOW_UNSECURE_COMMANDS=true enables deprecated set-env and add-path commands, allowing environment injection.' as description, '' as triggers_csv
from b_yaml where wf % 7 = 0"""
M07 = f"""
select scan_id, path as file_path, 'CICD-007' as rule_id, {line_sql('substr(m, 1, 30)')} as line_number, 'HIGH' as rule_severity,
 concat('env: block contains what looks like a hardcoded credential (`', regexp_extract(m, p, 1), '`). Should reference secrets context.') as description, triggers_csv
from (select y.scan_id, y.path, y.content, s.triggers_csv, {_sql(V.HARDCODED_VALUE_PATTERN)} as p,
  unnest(regexp_extract_all(y.content, {_sql(V.HARDCODED_VALUE_PATTERN)}, 0)) as m from b_yaml y join {_WF} s on y.path = s.path)
where not contains(regexp_extract(m, {_sql(V.HARDCODED_VALUE_PATTERN)}, 2), chr(36) || '{{{{')""".replace("regexp_extract(m, p, 1)", f"regexp_extract(m, {_sql(V.HARDCODED_VALUE_PATTERN)}, 1)")

for _name, _m_sql, _m_rule in [
    ("m01_script_injection", M01, misconfig.script_injection),
    ("m02_untrusted_checkout", M02, misconfig.untrusted_checkout),
    ("m03_broad_permissions", M03, misconfig.broad_permissions),
    ("m04_unpinned_actions", M04, misconfig.unpinned_actions),
    ("m05_unhashed_cache", M05, misconfig.unhashed_cache),
    ("m06_unsafe_commands", M06, misconfig.unsafe_commands),
    ("m07_hardcoded_values", M07, misconfig.hardcoded_values),
]:
    query(_name, _m_sql.replace("{{{{", "{{").replace("}}}}", "}}"))(lambda t, rule=_m_rule: _run_rules(t, [rule]))

_ALL_M = " union all ".join(f"select * from ({s})" for s in [M01, M02, M03, M04, M05, M06, M07]).replace("{{{{", "{{").replace("}}}}", "}}")


@query("m08_all_misconfigs", _ALL_M)
def _(t):
    return _run_rules(t, misconfig.RULES)


@query("m01_m04_fix_texts", f"""
select s.path as file_path, 'CICD-001' as rule_id, concat('Dangerous context: ', c.ctx) as detail,
 concat('Pass the value via an environment variable instead:', chr(10), '  env:', chr(10), '    SAFE_VAL: ', chr(36), '{{{{ toJSON(', c.ctx, ') }}}}', chr(10), 'Then reference $SAFE_VAL in the run block.') as fix_suggestion
 {_M01_FROM}
union all
select s.path, 'CICD-004', concat('uses: ', s.uses),
 concat('Pin to a full commit SHA:', chr(10), '  uses: ', {_ACTION}, '@<40-char-SHA>  # ', {_REF}, chr(10), 'Find SHA: https://github.com/', {_ACTION}, '/commits')
from {_STEPS} where {_M04_WHERE}""".replace("{{{{", "{{").replace("}}}}", "}}"))
def _(t):
    return misconfig.misconfig_findings(t.yaml, [misconfig.script_injection, misconfig.unpinned_actions]).select(
        "file_path", "rule_id", "detail", "fix_suggestion")


@query("a07_write_scope_counts", """
select distinct scan_id, path, case when wf_perm_str = '' then n_write_scopes else 0 end as write_scopes from b_wsteps""")
def _(t):
    return workflows.parse_workflows(t.yaml).select("scan_id", "path", misconfig.write_scope_count(F.col("perms")).alias("write_scopes"))


def _first_of_many_runs(context: str, check: str) -> str:
    return f"""select s.scan_id, s.path as file_path, 'SG-{check}' as rule_id, {line_sql(repr(context))} as line_number, 'ERROR' as rule_severity
from {_STEPS} where contains(s.run, concat(chr(36), '{{{{ {context} }}}}'))""".replace("{{{{", "{{").replace("}}}}", "}}")


G = {
    "g01_title_in_run": (structural.title_in_run, _first_of_many_runs("github.event.pull_request.title", "cicd-script-injection-pr-title")),
    "g02_issue_body_in_run": (structural.issue_body_in_run, _first_of_many_runs("github.event.issue.body", "cicd-script-injection-issue-body")),
    "g03_target_with_write_all": (structural.target_with_write_all, f"""
select s.scan_id, s.path as file_path, 'SG-cicd-prt-write-all' as rule_id, {line_sql(repr('pull_request_target'))} as line_number, 'ERROR' as rule_severity
from {_WF} s join b_yaml y on s.path = y.path where wf_perm_str = 'write-all' and contains(concat(',', triggers_csv, ','), ',pull_request_target,')"""),
    "g04_tag_pinned": (structural.tag_pinned, f"""
select scan_id, path as file_path, 'SG-cicd-unpinned-action-tag' as rule_id, line_no as line_number, 'WARNING' as rule_severity
from yaml_lines where regexp_matches(line, {_sql(V.TAG_PINNED_PATTERN)})"""),
    "g05_branch_pinned": (structural.branch_pinned, f"""
select scan_id, path as file_path, 'SG-cicd-unpinned-action-branch' as rule_id, line_no as line_number, 'ERROR' as rule_severity
from yaml_lines where regexp_matches(line, {_sql(V.BRANCH_PINNED_PATTERN)})"""),
    "g06_write_all_token": (structural.write_all_token, f"""
select s.scan_id, s.path as file_path, 'SG-cicd-token-write-all' as rule_id, {line_sql(repr('write-all'))} as line_number, 'WARNING' as rule_severity
from (select * from {_WF} where wf_perm_str = 'write-all' union all select * from {_WF} where wf % 11 = 0) s join b_yaml y on s.path = y.path"""),
    "g07_unhashed_cache_key": (structural.unhashed_cache_key, f"""
select s.scan_id, s.path as file_path, 'SG-cicd-cache-no-hash' as rule_id, {line_sql(repr('actions/cache'))} as line_number, 'WARNING' as rule_severity
from {_STEPS} where contains(s.uses, 'actions/cache@') and s.with_key is not null and not contains(s.with_key, 'hashFiles(')"""),
}
for _name, (_g_rule, _g_sql) in G.items():
    query(_name, _g_sql)(lambda t, rule=_g_rule: misconfig.misconfig_findings(t.yaml, [rule]).select(*_M[:5]))


def _local_action_rule():
    """A caller's own rule: one hit per job that uses an action of the repository itself."""
    local = F.filter("jobs", lambda job: F.exists(job["steps"], lambda s: F.coalesce(s["uses"].startswith("./"), F.lit(False))))
    return F.transform(local, lambda job: misconfig.hit("USR-1", "Local action", F.lit(1).cast("bigint"), "LOW", job["job_name"]))


@query("x02_user_workflow_rule", """
select distinct scan_id, path as file_path, job_name as description from b_wsteps where starts_with(uses, './')""")
def _(t):
    return misconfig.misconfig_findings(t.yaml, [_local_action_rule]).select("scan_id", "file_path", "description")


@query("s06_static_analysis", """
select scan_id, concat('SG-rules-uses-s', cast(step_idx as varchar)) as rule_id, concat('rules.uses.s', cast(step_idx as varchar)) as rule_name,
 path as file_path, cast(case when job_idx = 0 then 10 + step_idx else 1 end as bigint) as line_number,
 case when step_idx = 3 then 'MEDIUM' else 'WARNING' end as rule_severity, case when step_idx = 3 then 'Semgrep rule match' else concat('m ', uses) end as description, 'semgrep' as source
from b_wsteps where uses is not null""")
def _(t):
    return static_analysis(t.static_reports).select(
        "scan_id", "rule_id", "rule_name", "file_path", "line_number", "rule_severity", "description", "source")
