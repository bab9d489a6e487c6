"""Inputs in the shapes the library reads, derived from the test tables.

Each view is one projection of one table, in SQL both engines take.  Spark runs
it with `selectExpr`, the checking engine as a common table expression.
`chr(36)` is a dollar sign, which Spark SQL would take for a variable.
"""

from __future__ import annotations

VIEWS = {
    # documents -> repo_files, pre-classification; content has one planted token per doc
    "b_files": r"""
select doc_id % 40 as scan_id,
 concat('https://github.com/org', cast((doc_id % 40) % 7 as string), '/repo', cast(doc_id % 40 as string)) as repo_url,
 case doc_id % 16
  when 0 then concat('.github/workflows/ci_', cast(doc_id as string), '.yml')
  when 1 then concat('.github/workflows/rel_', cast(doc_id as string), '.yaml')
  when 2 then concat('.env.', cast(doc_id as string))
  when 3 then concat('svc/d', cast(doc_id as string), '/.env')
  when 4 then concat('docker/Dockerfile.', cast(doc_id as string))
  when 5 then concat('d', cast(doc_id as string), '/Dockerfile')
  when 6 then concat('src/m', cast(doc_id as string), '.py')
  when 7 then concat('node_modules/p', cast(doc_id as string), '/index.js')
  when 8 then concat('d', cast(doc_id as string), '/requirements.txt')
  when 9 then concat('d', cast(doc_id as string), '/package.json')
  when 10 then concat('img/logo', cast(doc_id as string), '.png')
  when 11 then concat('docs/', cast(doc_id as string), '.md')
  when 12 then concat('d', cast(doc_id as string), '/build')
  when 13 then concat('keys/id', cast(doc_id as string), '.PEM')
  when 14 then concat('d', cast(doc_id as string), '/secrets.yml')
  else concat('d', cast(doc_id as string), '/Jenkinsfile') end as path,
 concat(text, chr(10), case doc_id % 17
  when 1 then concat('AKIA', upper(substr(md5(cast(doc_id as string)), 1, 16)))
  when 2 then concat('aws_secret_key = ', substr(concat(md5(cast(doc_id as string)), md5(text)), 1, 40))
  when 3 then concat('ghp', '_', substr(concat(md5(cast(doc_id as string)), md5(text)), 1, 36))
  when 4 then concat('gho', '_', substr(concat(md5(cast(doc_id as string)), md5(text)), 1, 36))
  when 5 then concat('ghs', '_', substr(concat(md5(cast(doc_id as string)), md5(text)), 1, 36))
  when 6 then concat('api_key = "', substr(md5(cast(doc_id as string)), 1, 24), '"')
  when 7 then concat('-----BEGIN ', 'RSA PRIVATE KEY-----')
  when 8 then concat('eyJ', substr(md5(text), 1, 10), '.', substr(md5(text), 3, 8), '.', substr(md5(text), 5, 8))
  when 9 then concat('xox', 'b-', substr(md5(cast(doc_id as string)), 1, 20))
  when 10 then concat('AI', 'za', substr(concat(md5(cast(doc_id as string)), md5(text)), 1, 35))
  when 11 then concat('sk', '_live_', substr(md5(cast(doc_id as string)), 1, 24))
  when 12 then concat('password = "', substr(md5(cast(doc_id as string)), 1, 12), '"')
  when 13 then concat('mysql', '://u:', substr(md5(cast(doc_id as string)), 1, 8), '@db')
  when 14 then concat('//registry.npmjs.org/:', '_authToken=', substr(md5(cast(doc_id as string)), 1, 20))
  when 15 then concat('docker_token: "', substr(md5(cast(doc_id as string)), 1, 16), '"')
  when 16 then 'token: ${ {secrets.T} }'
  else 'nothing here' end) as content
from documents
""",
    # events -> exploded workflow steps; 8 events per workflow, 2 jobs x 4 steps
    "b_steps": r"""
select cast(floor(event_id / 8) as bigint) % 40 as scan_id,
 concat('.github/workflows/w', cast(cast(floor(event_id / 8) as bigint) as string), '.yml') as path,
 cast(floor((event_id % 8) / 4) as int) as job_idx,
 concat('job', cast(cast(floor((event_id % 8) / 4) as int) as string)) as job_name,
 cast(event_id % 4 as int) as step_idx,
 case cast(floor(event_id / 8) as bigint) % 5 when 0 then 'push' when 1 then 'pull_request' when 2 then 'pull_request_target' when 3 then 'push,schedule' else 'push,pull_request_target,schedule,workflow_dispatch' end as triggers_csv,
 case cast(floor(event_id / 8) as bigint) % 4 when 0 then 'write-all' when 1 then null else '' end as wf_perm_str,
 cast(cast(floor(event_id / 8) as bigint) % 6 as int) as n_write_scopes,
 case user_id % 8 when 0 then 'actions/checkout@v4' when 1 then 'actions/checkout@main' when 2 then 'actions/cache@v3'
  when 3 then concat('acme/tool@', md5(cast(event_id as string))) when 4 then './local' when 5 then null
  when 6 then 'actions/cache@master' else concat('acme/other@', substr(md5(cast(event_id as string)), 1, 7)) end as uses,
 case event_type when 'error' then concat('echo ', chr(36), '{{ github.event.issue.title }}')
  when 'signup' then concat('echo ', chr(36), '{{ github.head_ref }} ', chr(36), '{{ github.event.issue.body }}')
  when 'click' then 'make' when 'purchase' then concat('echo ', chr(36), '{{ github.event.pull_request.title }}') else null end as run,
 case cast(floor(value) as bigint) % 3 when 0 then concat(chr(36), '{{ github.event.pull_request.head.sha }}') when 1 then 'refs/heads/main' else null end as with_ref,
 case event_id % 3 when 0 then concat('k-', chr(36), '{{ hashFiles(x) }}') when 1 then 'static' else null end as with_key
from events
""",
    # orders -> scans; a repo is a customer
    "b_scans": r"""
select o_orderkey as scan_id, concat('https://github.com/org', cast(o_custkey % 10 as string), '/repo', cast(o_custkey as string)) as repo_url,
 cast(o_orderdate as timestamp) as scanned_at from orders
""",
    # lineitem -> findings before scoring
    "b_findings": r"""
select l_orderkey as scan_id, cast(l_linenumber as bigint) as seq,
 concat('RULE-', cast(1 + l_partkey % 7 as string)) as rule_id,
 case l_suppkey % 5 when 0 then '.github/workflows/ci.yml' when 1 then '.env' when 2 then 'svc/.env' when 3 then 'docker/run.sh' else 'src/app.py' end as file_path,
 cast(l_linenumber as bigint) as line_number,
 case l_returnflag when 'A' then 'secret' when 'N' then 'misconfig' else 'dependency' end as finding_type,
 case l_partkey % 3 when 0 then 'CRITICAL' when 1 then 'HIGH' else 'MEDIUM' end as rule_severity,
 case when l_linestatus = 'O' then 'HIGH' else 'MEDIUM' end as confidence,
 case l_suppkey % 6 when 0 then 'push' when 1 then 'pull_request' when 2 then 'push,schedule' when 3 then 'schedule' when 4 then 'push,pull_request,schedule,workflow_dispatch,release' else '' end as triggers_csv,
 cast(l_partkey % 101 as double) / 10e0 as base_score,
 case when l_linestatus = 'O' then 'NETWORK' else 'LOCAL' end as attack_vector
from lineitem
""",
    # lineitem -> raw dependency vulnerabilities before dedupe
    "b_vulns": r"""
select l_orderkey % 40 as scan_id, l_orderkey * 10 + l_linenumber as ordinal,
 case when l_returnflag = 'N' then 'node' else 'python' end as ecosystem,
 concat('pkg', cast(l_partkey % 200 as string)) as package,
 case l_suppkey % 4 when 0 then '' when 1 then concat('GHSA-', substr(md5(cast(l_partkey as string)), 1, 4)) else concat('CVE-2024-', lpad(cast(l_partkey % 150 as string), 5, '0')) end as cve_id,
 concat('1.', cast(l_suppkey % 12 as string), '.', cast(l_linenumber as string)) as version,
 case when l_suppkey % 3 = 0 then null else concat('2.', cast(l_suppkey % 5 as string), '.0') end as fix_version,
 case when l_returnflag = 'N' then 'package.json' else 'requirements.txt' end as file_path
from lineitem
""",
    # part -> CVE feed; every seventh id deliberately missing
    "b_nvd": r"""
select concat('CVE-2024-', lpad(cast(p_partkey as string), 5, '0')) as cve_id, cast(p_partkey % 101 as double) / 10e0 as base_score,
 case when p_size % 2 = 0 then 'NETWORK' else 'LOCAL' end as attack_vector,
 case p_partkey % 4 when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as severity, p_name as description
from part where p_partkey % 7 <> 3
""",
    # part -> affected version ranges, for E07
    "b_advisories": r"""
select concat('pkg', cast(p_partkey % 200 as string)) as package, case when p_partkey % 2 = 0 then 'node' else 'python' end as ecosystem,
 concat('CVE-2024-', lpad(cast(p_partkey % 150 as string), 5, '0')) as cve_id,
 concat('1.', cast(p_size % 9 as string), '.0') as introduced, concat('1.', cast(p_size % 9 + 3 as string), '.0') as fixed
from part
""",
    # events -> scan log lines
    "b_logs": r"""
select user_id as scan_id, cast(ts as timestamp) as ts, event_id as line_no,
 case event_type when 'error' then concat('Scan complete - ', cast(event_id % 4 as string), ' critical . ', cast(event_id % 7 as string), ' high . ', cast(event_id % 11 as string), ' medium . ', cast(event_id % 3 as string), ' low')
  when 'view' then 'Phase 2 - Security Scanners' when 'click' then '   ' when 'purchase' then 'tool timed out, error' else 'WARN high rate' end as line
from events
""",
}
