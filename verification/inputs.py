"""The derived inputs, for Spark and for the checking engine.

`Inputs` gives them as DataFrames.  `with_views` puts the common table
expressions a query names before it, so both sides start from the same rows.
Reports and workflow files are written as text from columns: Spark parses the
text, the checking engine computes the expected rows from the columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsift.schemas import FINDINGS, conform
from verification.views import VIEWS

NL = "chr(10)"


def _text(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _line(*parts: str) -> str:
    return _text(*parts, NL)


# --- Workflow files as text, from the columns of b_steps -----------------------

WORKFLOW_NO = "cast(replace(replace(path, '.github/workflows/w', ''), '.yml', '') as bigint)"

STEP_TEXT = _text(
    "case when step_idx = 0 then " + _text(
        _line("'  '", "job_name", "':'"), _line("'    runs-on: ubuntu'"),
        f"case when job_idx = 1 and wf % 11 = 0 then {_line(repr('    permissions: write-all'))} else '' end",
        _line("'    steps:'")) + " else '' end",
    _line("'      - name: s'", "cast(step_idx as string)"),
    f"case when uses is not null then {_line(repr('        uses: '), 'uses')} else '' end",
    f"case when run is not null then {_line(repr('        run: '), 'chr(39)', 'run', 'chr(39)')} else '' end",
    f"case when with_ref is not null or with_key is not null then {_line(repr('        with:'))} else '' end",
    f"case when with_ref is not null then {_line(repr('          ref: '), 'chr(39)', 'with_ref', 'chr(39)')} else '' end",
    f"case when with_key is not null then {_line(repr('          key: '), 'chr(39)', 'with_key', 'chr(39)')} else '' end",
)

_SCOPES = ["contents", "issues", "packages", "deployments", "checks"]
HEAD_TEXT = _text(
    _line("'name: w'", "cast(wf as string)"),
    "case when wf % 3 = 0 then " + _line("'on: ['", "replace(triggers_csv, ',', ', ')", "']'")
    + " when wf % 3 = 1 or triggers_csv like '%,%' then "
    + _line("'on:'", NL, "'  '", f"replace(triggers_csv, ',', concat(':', {NL}, '  '))", "':'")
    + " else " + _line("'on: '", "triggers_csv") + " end",
    "case when wf_perm_str = 'write-all' then " + _line("'permissions: write-all'")
    + " when wf_perm_str is null then '' else " + _text(
        _line("'permissions:'"), _line("'  actions: read'"),
        *[f"case when n_write_scopes > {i} then {_line(repr(f'  {s}: write'))} else '' end" for i, s in enumerate(_SCOPES)])
    + " end",
    _line("'env:'"), _line("'  PLAIN: x'"),
    f"case when wf % 7 = 0 then {_line(repr('  ACTIONS_ALLOW_UNSECURE_COMMANDS: true'))} else '' end",
    f"case when wf % 9 = 0 then {_line(repr('  token: abcdefgh'))} else '' end",
    f"case when wf % 10 = 3 then {_line(repr('  api_key: '), 'chr(36)', repr('{{ secrets.K }}'))} else '' end",
    _line("'jobs:'"),
)

# --- Audit reports as text, from the columns of b_vulns and b_nvd --------------

PYTHON_DEP = _text(
    """'{"name":"'""", "package", """'","version":"'""", "version", """'","vulns":[{"id":"'""", "cve_id",
    """'","fix_versions":['""",
    "case when fix_version is null then '' else concat(chr(34), fix_version, chr(34), ', ', chr(34), '9.9', chr(34)) end",
    """'],"description":"d '""", "package", """'"}]}'""")

NODE_REPORT = _text(
    """'{"vulnerabilities":{"'""", "package", """'":{"range":"'""", "version", """'","fixAvailable":'""",
    """case when fix_version is null then 'false' when ordinal % 2 = 0
       then concat('{"name":"', package, '","version":"', fix_version, '"}') else 'true' end""",
    """',"via":["other",{"title":"t '""", "package", """'","cve":['""",
    "case when cve_id = '' then '' else concat(chr(34), cve_id, chr(34)) end", """']}]}}}'""")

NVD_NO = "cast(substr(cve_id, 10) as int)"
_CVSS = _text("""'[{"cvssData":{"baseScore":'""", "cast(base_score as string)", """',"baseSeverity":"'""", "severity",
              """'","attackVector":"'""", "attack_vector", """'","privilegesRequired":"NONE"}}]'""")
CVE_BODY = _text(
    """'{"vulnerabilities":[{"cve":{"id":"'""", "cve_id", """'","metrics":{'""",
    f"""case when cve_no % 10 = 9 then '' when cve_no % 3 = 0 then concat('"cvssMetricV30":', {_CVSS})
        else concat('"cvssMetricV31":', {_CVSS}, ',"cvssMetricV30":[{{"cvssData":{{"baseScore":1.5}}}}]') end""",
    """'},"descriptions":[{"lang":"es","value":"no"},{"lang":"en","value":"'""", "description", """'"}],"references":['""",
    *[_text(f"""'{"," if i else ""}{{"url":"https://r/{i}/'""", "cve_id", """'"}'""") for i in range(7)],
    """']}}]}'""")

STATIC_ITEM = _text(
    """'{"check_id":"rules.uses.s'""", "cast(step_idx as string)", """'","path":"/scan/'""", "path", """'"'""",
    """case when job_idx = 0 then concat(',"start":{"line":', cast(10 + step_idx as string), '}') else '' end""",
    """case when step_idx = 3 then ',"extra":{}' else concat(',"extra":{"severity":"warning","message":"m ', uses, '"}') end""",
    "'}'")

# Views on views: name -> (source, expressions added to all its columns, filter).
ADDED = {
    "b_wsteps": ("b_steps", [f"{WORKFLOW_NO} as wf"], None),
    "b_wtext": ("b_wsteps", [f"{STEP_TEXT} as step_text", f"{HEAD_TEXT} as head_text"], None),
    "b_nvd_no": ("b_nvd", [f"{NVD_NO} as cve_no"], None),
    "b_requests": ("b_scans", [
        "case when scan_id % 10 = 0 then 'http://example.com/x' when scan_id % 10 = 1 then concat('  ', repo_url, ' ') else repo_url end as asked_url",
        "scan_id % 2 = 0 as skip_secrets", "scan_id % 3 = 0 as skip_misconfigs", "scan_id % 5 = 0 as skip_deps"], None),
    "b_reports": ("b_scans", [
        "scan_id % 97 as report_scan", "case when scan_id % 2 = 0 then 'html' else 'sarif' end as ext",
        "concat('audit_r_', cast(scan_id as string)) as path"], None),
}

# Views only the checking engine needs.
PLAIN_SQL = {
    "b_yaml": """
select scan_id, path, wf, concat(head_text, string_agg(step_text, '' order by job_idx, step_idx)) as content
from b_wtext group by scan_id, path, wf, head_text""",
    "yaml_lines": """
select scan_id, path, wf, content, unnest(string_split(content, chr(10))) as line,
  generate_subscripts(string_split(content, chr(10)), 1) as line_no from b_yaml""",
    "repo_files": r"""
select *, lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) as ext from (
  select *, regexp_extract(path, '[^/]*$') as name from b_files)""",
    "kept_files": r"""
select *,
  contains(path, '.github/workflows/') and (name like '%.yml' or name like '%.yaml') as is_workflow,
  starts_with(name, '.env') or name in ('secrets.yml', 'secrets.yaml', '.secrets') as is_env_file,
  name in ('Dockerfile', 'dockerfile') or starts_with(name, 'Dockerfile.') as is_dockerfile,
  name in ('requirements.txt', 'package.json', 'Pipfile', 'pyproject.toml', 'setup.cfg', 'setup.py',
           'Gemfile', 'go.mod', 'composer.json', 'pom.xml') as is_dependency_manifest
from repo_files
where not regexp_matches(path, '(^|/)(\.git|node_modules|__pycache__|\.venv|venv|\.env_dir|vendor|dist|build|\.tox|\.mypy_cache)(/|$)')
  and (ext in ('.yml','.yaml','.json','.env','.sh','.bash','.py','.js','.ts','.rb','.go','.java','.tf','.toml','.ini','.cfg',
               '.conf','.config','.xml','.properties','.secrets','.key','.pem','.md')
    or name in ('Dockerfile','docker-compose.yml','docker-compose.yaml','Jenkinsfile','.travis.yml','circle.yml',
                'bitbucket-pipelines.yml','azure-pipelines.yml','cloudbuild.yaml','.npmrc','.pypirc','Makefile','makefile',
                'requirements.txt','package.json','package-lock.json','Pipfile','Pipfile.lock','poetry.lock','go.mod','go.sum',
                'Gemfile','Gemfile.lock','composer.json')
    or starts_with(name, '.env') or contains(name, 'Dockerfile'))""",
    "scored": """
select *, case when risk_score >= 9 then 'CRITICAL' when risk_score >= 7 then 'HIGH' when risk_score >= 4 then 'MEDIUM' else 'LOW' end as severity
from (select *, round(least(10e0, exploitability + blast_radius + trigger_context), 1) as risk_score from (
 select *,
  case finding_type
   when 'secret' then case when confidence = 'HIGH' then least(4e0, rule_points + 0.5e0) else rule_points end
   when 'misconfig' then rule_points
   else case when attack_vector = 'NETWORK' then least(4e0, round(base_score / 10e0 * 4e0, 1) + 0.5e0) else round(base_score / 10e0 * 4e0, 1) end
  end as exploitability,
  case finding_type
   when 'secret' then case when contains(file_path, '.github/workflows') then 3e0 when starts_with(file_path, '.env') then 2.5e0
     when contains(lower(file_path), 'docker') then 2e0 else 1e0 end
   when 'misconfig' then least(3e0, 1e0 + 0.5e0 * n_triggers)
   else 2e0 end as blast_radius,
  case finding_type
   when 'secret' then case when contains(file_path, '.github/workflows') then 3e0 when contains(file_path, '.env') then 2.5e0 else 1e0 end
   when 'misconfig' then case when regexp_matches(triggers_csv, '(^|,)pull_request(_target)?(,|$)') then 3e0
     when regexp_matches(triggers_csv, '(^|,)push(,|$)') then 2e0 else 1e0 end
   else 2e0 end as trigger_context
 from (select *, case rule_severity when 'CRITICAL' then 4e0 when 'HIGH' then 3e0 when 'MEDIUM' then 2e0 else 1e0 end as rule_points,
   case when triggers_csv = '' then 0 else len(string_split(triggers_csv, ',')) end as n_triggers,
   concat('Rule name ', rule_id) as rule_name, concat('Found ', rule_id, ' in ', file_path, ' on line ', cast(line_number as varchar)) as description
   from b_findings)))""",
    "links": "select repo_url, scan_id, lag(scan_id) over (partition by repo_url order by scan_id) as prev_scan_id from b_scans",
    "now_keys": "select distinct scan_id, rule_id, file_path from b_findings",
    "before_keys": "select l.scan_id, k.rule_id, k.file_path from now_keys k join links l on k.scan_id = l.prev_scan_id",
    "keyed_vulns": "select *, case when coalesce(cve_id, '') = '' then concat('NO-CVE-', package) else cve_id end as cve_key from b_vulns",
    "first_vulns": """
select * from (select *, row_number() over (partition by scan_id, cve_key, package order by case ecosystem when 'python' then 0 else 1 end,
  file_path, ordinal, version nulls first, fix_version nulls first) as rn from keyed_vulns) where rn = 1""",
    "dep_findings": """
select v.scan_id, v.cve_key as cve_id, concat('DEP-', v.cve_key) as rule_id, v.package, v.version, v.ecosystem, v.file_path,
  coalesce(n.base_score, 0e0) as base_score,
  case when v.cve_key not like 'CVE-%' then 'MEDIUM' when n.cve_id is null then 'UNKNOWN' else upper(n.severity) end as rule_severity,
  coalesce(n.attack_vector, 'UNKNOWN') as attack_vector,
  coalesce(nullif(n.description, ''), concat('d ', v.package)) as description,
  coalesce(v.fix_version, 'N/A') as fixed_version,
  case when v.fix_version is null then 'No fix available yet.'
    else concat('Upgrade to: ', v.package, case v.ecosystem when 'python' then '==' else '@' end, v.fix_version) end as fix_suggestion
from first_vulns v left join b_nvd n on v.cve_key = n.cve_id and v.cve_key like 'CVE-%'""",
    "clean_logs": r"select scan_id, ts, line_no, regexp_replace(line, '\s+$', '') as line from b_logs where regexp_replace(line, '\s+$', '') <> ''",
    "log_counts": r"""
select scan_id, ts, line_no, try_cast(regexp_extract(line, '(?i)(\d+) critical.*?(\d+) high.*?(\d+) medium.*?(\d+) low', 1) as bigint) as critical,
 try_cast(regexp_extract(line, '(?i)(\d+) critical.*?(\d+) high.*?(\d+) medium.*?(\d+) low', 2) as bigint) as high,
 try_cast(regexp_extract(line, '(?i)(\d+) critical.*?(\d+) high.*?(\d+) medium.*?(\d+) low', 3) as bigint) as medium,
 try_cast(regexp_extract(line, '(?i)(\d+) critical.*?(\d+) high.*?(\d+) medium.*?(\d+) low', 4) as bigint) as low
from clean_logs""",
    "log_summary": """
select scan_id, log_count, coalesce(s.critical, 0) as critical, coalesce(s.high, 0) as high, coalesce(s.medium, 0) as medium, coalesce(s.low, 0) as low from
 (select scan_id, count(*) as log_count from clean_logs group by scan_id) left join
 (select * from (select *, row_number() over (partition by scan_id order by ts desc, line_no desc) as rn from log_counts where critical is not null) where rn = 1) s
 using (scan_id)""",
}


def _view_sql() -> dict[str, str]:
    sql = {name: text.strip() for name, text in VIEWS.items()}
    for name, (source, expressions, where) in ADDED.items():
        sql[name] = f"select *, {', '.join(expressions)} from {source}" + (f" where {where}" if where else "")
    sql.update({name: text.strip() for name, text in PLAIN_SQL.items()})
    return sql


VIEW_SQL = _view_sql()


def with_views(sql: str) -> str:
    """The query with the views it names, and those they name, before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in needed and re.search(rf"\b{name}\b", text) and text is not VIEW_SQL[name]:
                visit(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = "with " + ",\n".join(f"{n} as ({VIEW_SQL[n]})" for n in needed)
    return f"{views},\n{sql[5:]}" if sql.startswith("with ") else f"{views}\n{sql}"


class Inputs:
    """The derived inputs as DataFrames over one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name in VIEWS:
            sql = re.sub(r"\bfrom (\w+)", lambda m: f"from parquet.`{self.sf_dir}/{m.group(1)}.parquet`", VIEWS[name].strip())
            return self.spark.sql(sql)
        source, expressions, where = ADDED[name]
        df = self.view(source).selectExpr("*", *expressions)
        return df.filter(where) if where else df

    def stream(self, name: str) -> DataFrame:
        """A view over a stream of its table's file, or files where the table is a directory.

        A pattern that names the table alone: streams take no path of a single file, but patterns that find one.
        """
        source = re.search(r"\bfrom (\w+)", VIEWS[name]).group(1)
        stream = self.spark.readStream.schema(self.table(source).schema).parquet(f"{self.sf_dir}/{{{source}}}.parquet")
        stream.createOrReplaceTempView(f"stream_of_{source}")
        return self.spark.sql(re.sub(r"\bfrom (\w+)", f"from stream_of_{source}", VIEWS[name].strip()))

    @property
    def files(self) -> DataFrame:
        return self.view("b_files")

    @property
    def yaml(self) -> DataFrame:
        """Workflow files; each is made of its eight steps."""
        grouped = self.view("b_wtext").groupBy("scan_id", "path", "wf", "head_text").agg(
            F.array_sort(F.collect_list(F.struct("job_idx", "step_idx", "step_text"))).alias("steps"))
        return grouped.select(
            F.lit("https://github.com/org/repo").alias("repo_url"), "scan_id", "path",
            F.concat("head_text", F.array_join(F.transform("steps", lambda s: s["step_text"]), "")).alias("content"))

    @property
    def findings(self) -> DataFrame:
        """Findings before scoring, in the library's table form; `seq` is kept for ordering."""
        raw = self.view("b_findings")
        shaped = raw.withColumns({
            "rule_name": F.concat(F.lit("Rule name "), "rule_id"),
            "description": F.concat(F.lit("Found "), "rule_id", F.lit(" in "), "file_path", F.lit(" on line "), F.col("line_number").cast("string")),
            "affected_triggers": F.when(F.col("triggers_csv") == "", F.array().cast("array<string>")).otherwise(F.split("triggers_csv", ",")),
            "item_index": F.col("seq"),
        })
        return conform(shaped, FINDINGS)

    @property
    def raw_vulns(self) -> DataFrame:
        """Raw vulnerabilities as both audits give them."""
        return self.view("b_vulns").select(
            "scan_id", "ordinal", "ecosystem", "package", "cve_id", "version", "file_path",
            F.array_compact(F.array("fix_version")).alias("fix_versions"),
            F.concat(F.lit("d "), "package").alias("description"),
            F.when(F.col("ecosystem") == "python", 0).otherwise(1).alias("source_rank"))

    @property
    def nvd(self) -> DataFrame:
        return self.view("b_nvd").withColumns({
            "privileges_required": F.lit("NONE"),
            "references": F.array(F.concat(F.lit("https://r/"), "cve_id"))})

    @property
    def python_reports(self) -> DataFrame:
        """One report per order: at most a few lines each."""
        rows = self.view("b_vulns").filter("ecosystem = 'python'").selectExpr(
            "scan_id", "floor(ordinal / 10) as report_no", "file_path", "ordinal", f"{PYTHON_DEP} as dep")
        return rows.groupBy("scan_id", "report_no", "file_path").agg(
            F.concat(F.lit('{"dependencies":['), F.array_join(F.array_sort(F.collect_list("dep")), ","), F.lit("]}")).alias("body"))

    @property
    def node_reports(self) -> DataFrame:
        return self.view("b_vulns").filter("ecosystem = 'node'").selectExpr("scan_id", "file_path", f"{NODE_REPORT} as body")

    @property
    def cve_responses(self) -> DataFrame:
        return self.view("b_nvd_no").selectExpr(
            "case when cve_no % 2 = 0 then cve_id end as cve_id", "timestamp'2024-01-01 00:00:00' as fetched_at", f"{CVE_BODY} as body")

    @property
    def static_reports(self) -> DataFrame:
        """One report per workflow: at most eight results."""
        items = self.view("b_wsteps").filter("uses is not null").selectExpr("scan_id", "path", f"{STATIC_ITEM} as item")
        return items.groupBy("scan_id", "path").agg(
            F.concat(F.lit('{"results":['), F.array_join(F.array_sort(F.collect_list("item")), ","), F.lit("]}")).alias("body")
        ).select("scan_id", F.lit("/scan").alias("root"), "body")
