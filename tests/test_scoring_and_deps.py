"""Scores, dependency audits, advisories, the CVE table."""

import json

import pytest
from pyspark.sql import functions as F

from fleetsift.operators import deps, scoring
from fleetsift.schemas import CVE_FEED, FINDINGS, conform
from fleetsift.sources import audit_reports


def score(spark, **fields):
    columns = ", ".join(f"{k} {'double' if k == 'base_score' else 'string'}" for k in fields)
    df = conform(spark.createDataFrame([tuple(fields.values())], columns), FINDINGS)
    row = scoring.score_findings(df).first()
    return row.risk_score, row.severity


@pytest.mark.parametrize("path, expected", [
    (".github/workflows/ci.yml", (10.0, "CRITICAL")), (".env", (9.0, "CRITICAL")), ("a/.env", (7.5, "HIGH")),
    ("docker/x", (7.0, "HIGH")), ("src/x.py", (6.0, "MEDIUM"))])
def test_critical_secret_by_place(spark, path, expected):
    assert score(spark, finding_type="secret", rule_severity="CRITICAL", confidence="MEDIUM", file_path=path) == expected


def test_confidence_is_capped(spark):
    def one(severity):
        return score(spark, finding_type="secret", rule_severity=severity, confidence="HIGH", file_path="x")[0]

    assert (one("CRITICAL"), one("HIGH"), one("MEDIUM"), one("odd")) == (6.0, 5.5, 4.5, 3.5)


@pytest.mark.parametrize("base, vector, expected", [
    (9.8, "NETWORK", (8.0, "HIGH")), (7.5, "LOCAL", (7.0, "HIGH")), (None, None, (4.0, "MEDIUM")), (10.0, "NETWORK", (8.0, "HIGH")), (0.0, "NETWORK", (4.5, "MEDIUM"))])
def test_dependency_scores(spark, base, vector, expected):
    assert score(spark, finding_type="dependency", base_score=base, attack_vector=vector) == expected


def test_unknown_type(spark):
    assert score(spark, finding_type="other") == (5.0, "MEDIUM")


def report_rows(spark, *bodies):
    return spark.createDataFrame([(1, f"d{i}/f", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)],
                                 "scan_id bigint, file_path string, body string")


def test_broken_reports_give_no_rows(spark):
    broken = report_rows(spark, "{", "", "[]", "null", {"dependencies": []}, {"vulnerabilities": {}})
    assert audit_reports.python_audit(broken).count() == 0
    assert audit_reports.node_audit(broken).count() == 0


def test_node_report_forms(spark):
    body = {"vulnerabilities": {
        "a": {"range": "<1", "fixAvailable": True, "via": ["b", {"title": "t", "cve": ["CVE-1", "CVE-2"]}, {"title": "u"}]},
        "c": {"fixAvailable": {"name": "c", "version": "2.0"}, "via": [{"cve": []}]},
        "d": {"range": "1", "fixAvailable": False, "via": [{"cve": "CVE-3"}]}}}
    rows = {(r.package, r.position.vuln_no): (r.version, r.cve_id, r.fix_versions, r.description) for r in audit_reports.node_audit(report_rows(spark, body)).collect()}
    assert rows == {("a", 1): ("<1", "CVE-1", ["True"], "t"), ("a", 2): ("<1", "", ["True"], "u"),
                    ("c", 0): ("", "", ["2.0"], ""), ("d", 0): ("1", "", [], "")}


def test_first_finding_of_a_cve_and_package_wins_across_files(spark):
    python = audit_reports.python_audit(report_rows(
        spark, {"dependencies": [{"name": "p", "version": "1", "vulns": [{"id": "CVE-1"}, {"id": ""}]}]},
        {"dependencies": [{"name": "p", "version": "2", "vulns": [{"id": "CVE-1"}]}, {"name": "q", "vulns": [{"id": "CVE-1", "fix_versions": ["3", "4"]}]}]}))
    node = audit_reports.node_audit(report_rows(spark, {"vulnerabilities": {"p": {"range": "9", "via": [{"cve": ["CVE-1"]}]}}}))
    feed = spark.createDataFrame([("CVE-1", 9.8, "critical", "NETWORK", "NONE", "from feed", ["u"], None)], CVE_FEED)
    rows = {(r.package_name, r.cve_id): r for r in deps.dependency_findings(deps.union_raw(python, node), feed).collect()}
    assert set(rows) == {("p", "CVE-1"), ("p", "NO-CVE-p"), ("q", "CVE-1")}
    first = rows[("p", "CVE-1")]
    assert (first.installed_version, first.file_path, first.rule_severity, first.description) == ("1", "d0/f", "CRITICAL", "from feed")
    assert rows[("q", "CVE-1")].fix_suggestion == "Upgrade to: q==3"
    none = rows[("p", "NO-CVE-p")]
    assert (none.rule_severity, none.base_score, none.attack_vector, none.fix_suggestion) == ("MEDIUM", 0.0, "UNKNOWN", "No fix available yet.")


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([("CVE-1", 1.0), ("CVE-2", 2.0)], "cve_id string, base_score double").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    new = spark.createDataFrame([("CVE-1", 9.0), ("CVE-3", 3.0)], "cve_id string, base_score double").withColumn("fetched_at", F.lit("2024-01-02").cast("timestamp"))
    assert {(r.cve_id, r.base_score) for r in deps.upsert_cves(old, new).collect()} == {("CVE-1", 9.0), ("CVE-2", 2.0), ("CVE-3", 3.0)}


def test_advisories_against_brute_force(spark):
    """Against the comparison that Python's own packaging tools make."""
    from packaging.version import Version

    versions = ["1.0", "1.0.0", "1.2", "1.10.0", "2.0.0rc1", "1.0.1.dev3", "0.9", "20230101120000", "^1.0"]
    declared = spark.createDataFrame([(1, f"f{i % 2}", "python", "p", v) for i, v in enumerate(versions * 3)],
                                     "scan_id bigint, file_path string, ecosystem string, package string, version string")
    ranges = [("CVE-1", "1.0.0", "1.10.0"), ("CVE-1", "1.0.0", "1.5.0"), ("CVE-2", "0.1", "1.0.1"), ("CVE-4", "0.1", "1.0.0"), ("CVE-5", "2.0", None), ("CVE-6", "1.3", "2"), ("CVE-3", "x", "9")]
    advisories = spark.createDataFrame([("python", "p", *r) for r in ranges] + [("node", "p", "CVE-9", "0.0", "9.0")],
                                       "ecosystem string, package string, cve_id string, introduced string, fixed string")
    expected = set()
    for row in {(r.file_path, r.version) for r in declared.collect() if r.version != "^1.0"}:
        for cve in {r[0] for r in ranges} - {"CVE-3"}:
            hits = [high for c, low, high in ranges
                    if c == cve and Version(low) <= Version(row[1]) and (high is None or Version(row[1]) < Version(high))]
            if hits:
                expected.add((*row, cve, min(hits, key=lambda v: Version(v or "0"))))
    assert {(r.file_path, r.version, r.cve_id, r.fixed) for r in deps.match_advisories(declared, advisories).collect()} == expected
    assert {r.version for r in deps.unparsed_versions(declared).collect()} == {"^1.0"}


def test_declared_dependencies(make_files):
    files = make_files(("a/requirements.txt", "# c\nDjango[x] == 3.2.1 ; python_version>'3'\nrequests>=2\n  flask==2.0\n-r other.txt\n"),
                       ("b/package.json", '{"dependencies": {"left-pad": "^1.0.0", "x": "~2.1"}, "devDependencies": {"y": "1"}}'),
                       ("node_modules/z/package.json", '{"dependencies": {"no": "1"}}'), ("c/package.json", "{"))
    assert {(r.ecosystem, r.package, r.version) for r in deps.declared_dependencies(files).collect()} == {
        ("python", "Django", "3.2.1"), ("python", "flask", "2.0"), ("node", "left-pad", "1.0.0"), ("node", "x", "2.1")}


def test_versions_sort_as_releases_do(spark):
    from pyspark.sql import functions as F

    from fleetsift.functions import versions

    ascending = [["0.9"], ["1.0.dev1"], ["1.0a2", "1.0-alpha.2"], ["1.0b1"], ["1.0rc1", "1.0.0-rc.1"], ["1", "1.0", "v1.0.0", "01.00"], ["1.1"], ["1.10"], ["2"],
                 ["20230101120000"], ["20230101120001"]]
    pairs = [(v, k) for k, group in enumerate(ascending) for v in group]
    keys = {r.v: r.key for r in spark.createDataFrame(pairs, "v string, k int").select("v", versions.version_key(F.col("v")).alias("key")).collect()}
    for v, k in pairs:
        for w, m in pairs:
            assert (keys[v] < keys[w]) == (k < m) and (keys[v] == keys[w]) == (k == m)
    odd = spark.createDataFrame([("^1.0",), (">=2",), ("",), (None,), ("1..2",)], "v string")
    assert all(r[0] is None for r in odd.select(versions.version_key(F.col("v"))).collect())


def test_advisories_without_a_fix_and_python_names(spark):
    from fleetsift.operators import deps

    declared = spark.createDataFrame([(1, "r.txt", "python", "Django_Rest", "1.5"), (1, "r.txt", "python", "other", "1.0"), (1, "p.json", "node", "Lib", "1.5")],
                                     "scan_id bigint, file_path string, ecosystem string, package string, version string")
    advisories = spark.createDataFrame([("python", "django-rest", "C1", "1.0", None), ("python", "Django.Rest", "C2", None, "2"), ("python", "other", "C3", "0", "1.0.0"),
                                        ("node", "lib", "C4", "1", None)], "ecosystem string, package string, cve_id string, introduced string, fixed string")
    got = {(r.package, r.cve_id, r.fixed) for r in deps.match_advisories(declared, advisories).collect()}
    assert got == {("Django_Rest", "C1", None), ("Django_Rest", "C2", "2")}
    raw = deps.raw_from_advisories(deps.match_advisories(declared, advisories)).collect()
    assert {tuple(r.fix_versions) for r in raw} == {(), ("2",)}


def test_python_specifiers_against_packaging(spark):
    from packaging.specifiers import SpecifierSet
    from packaging.version import Version

    from fleetsift.functions import specifiers, versions

    grid = ["0", "0.9", "1.0rc1", "1.0", "1.0.0.1", "1.0.1", "1.4", "1.4.2rc1", "1.4.2", "1.4.5", "1.4.10", "1.5rc1", "1.5", "1.5.1", "1.10", "2.0a1", "2.0", "2.0.1", "10"]
    texts = ["==1.0", "== 1.4.2", "===1.0", ">=1.4", "> 1.4", "<1.5", "<=1.5", "<2.0a1", ">=1.0,<2", ">=1.0, !=1.4.2, !=1.5.*,<2", "!=1.0", "!=1.4.*", "==1.4.*", "==1.*", "~=1.4.2", "~=1.4",
             "~=1.0.0", ">2,<1", "", ">=1.4.2rc1", "==1.4.2rc1", "<0"]
    rows = spark.createDataFrame([(t, v) for t in texts for v in grid], "t string, v string").withColumns({
        "i": specifiers.intervals(F.lit("python"), F.col("t")), "k": versions.version_key(F.col("v"))})
    inside = F.exists("i", lambda i: F.coalesce(i["low"] <= F.col("k"), F.lit(True)) & F.coalesce(F.col("k") < i["high"], F.lit(True)))
    for r in rows.select("t", "v", inside.alias("inside")).collect():
        if "*" in r.t and "==" in r.t and Version(r.v).is_prerelease:
            continue  # a series leaves out the pre-releases of its first release
        assert r.inside == SpecifierSet(r.t).contains(r.v, prereleases=True), (r.t, r.v)


@pytest.mark.parametrize("specifier, allowed", [
    ("^1.2.3", ["1.2.3", "1.2.4", "1.9"]), ("^0.2.3", ["0.2.3", "0.2.9"]), ("^0.0.3", ["0.0.3"]), ("^0.0", ["0.0.0", "0.0.3"]), ("^0", ["0.0.0", "0.0.3", "0.2.3", "0.2.9", "0.3.0"]),
    ("^1.x", ["1.0.0", "1.2.3", "1.2.4", "1.9"]), ("~1.2.3", ["1.2.3", "1.2.4"]), ("~1.2", ["1.2.3", "1.2.4"]), ("~1", ["1.0.0", "1.2.3", "1.2.4", "1.9"]), ("~> 1.2", ["1.2.3", "1.2.4"]),
    ("1.2", ["1.2.3", "1.2.4"]), ("1.2.x", ["1.2.3", "1.2.4"]), ("v1.2.3", ["1.2.3"]), ("=1.2.3+build.5", ["1.2.3"]), (">1.2", ["1.9", "2.0.0", "2.3.4", "2.3.5"]), (">1.9.0", ["2.0.0", "2.3.4", "2.3.5"]),
    ("<= 0.2", ["0.0.0", "0.0.3", "0.2.3", "0.2.9"]), ("<0.2.3", ["0.0.0", "0.0.3"]), ("1.2.4 - 2.3.4", ["1.2.4", "1.9", "2.0.0", "2.3.4"]), ("1.9 - 2.3", ["1.9", "2.0.0", "2.3.4", "2.3.5"]),
    (">=1.9.0 <2.0.0-0", ["1.9"]), ("^0.0.3 || ^2 || 1.2.3", ["0.0.3", "1.2.3", "2.0.0", "2.3.4", "2.3.5"]), (">= 2.0.0", ["2.0.0", "2.3.4", "2.3.5"]), (">2 <1", []), ("<1.0.0 || ", None),
    ("*", None), ("", None), ("X", None)])
def test_node_specifiers(spark, specifier, allowed):
    from fleetsift.functions import specifiers, versions

    grid = ["0.0.0", "0.0.3", "0.2.3", "0.2.9", "0.3.0", "1.0.0", "1.2.3", "1.2.4", "1.9", "2.0.0", "2.3.4", "2.3.5"]
    rows = spark.createDataFrame([(v,) for v in grid], "v string").withColumns({
        "i": specifiers.intervals(F.lit("node"), F.lit(specifier)), "k": versions.version_key(F.col("v"))})
    inside = F.exists("i", lambda i: F.coalesce(i["low"] <= F.col("k"), F.lit(True)) & F.coalesce(F.col("k") < i["high"], F.lit(True)))
    assert [r.v for r in rows.filter(inside).collect()] == (grid if allowed is None else allowed)


def test_specifiers_that_are_not_understood(spark):
    odd = [("node", "latest"), ("node", "git+ssh://git@h/x#v1"), ("node", "file:../x"), ("node", "npm:a@^1"), ("node", "!=1"), ("node", "^1 || next"), ("node", None),
           ("python", "1.0"), ("python", "@ https://h/x.whl"), ("python", "^1.0"), ("python", ">=1.*"), ("python", "~=1"), ("python", "==1!2.0"), ("python", ">=1.0.post1"), ("python", None)]
    declared = spark.createDataFrame([(1, "f", e, f"p{k}", "runtime", s) for k, (e, s) in enumerate([*odd, ("node", "^1"), ("python", "")])],
                                     "scan_id bigint, file_path string, ecosystem string, package string, scope string, specifier string")
    assert {r.package for r in deps.unmatched_specifiers(declared).collect()} == {f"p{k}" for k in range(len(odd))}
    advisories = declared.select("ecosystem", "package", F.lit("C").alias("cve_id"), F.lit(None).cast("string").alias("introduced"), F.lit("9").alias("fixed"))
    got = {(r.package, r.is_range, r.certain) for r in deps.match_specifiers(declared, advisories).collect()}
    assert got == {(f"p{len(odd)}", True, True), (f"p{len(odd) + 1}", True, False)}


def test_declared_specifiers(make_files):
    files = make_files(("a/requirements.txt", "# c\nDjango[x] == 3.2.1 ; python_version>'3'\nrequests >=2, \\\n  <3  # why\nflask\n-r other.txt\n--hash=sha256:1\n"
                                              "old (>=1.0)\nlocal @ file:///x\nh==1 --hash=sha256:ab\n!\n"),
                       ("b/package.json", '{"dependencies": {"a": "^1.0.0"}, "devDependencies": {"y": "1 || 2"}, "optionalDependencies": {"z": "*"}, "peerDependencies": {"no": "1"}}'),
                       ("c/package.json", "{"), ("d/package.json", '{"dependencies": null, "devDependencies": {}}'))
    assert {(r.package, r.scope, " ".join(r.specifier.split())) for r in deps.declared_specifiers(files).collect()} == {
        ("Django", "runtime", "== 3.2.1"), ("requests", "runtime", ">=2, <3"), ("flask", "runtime", ""), ("old", "runtime", ">=1.0"), ("local", "runtime", "@ file:///x"), ("h", "runtime", "==1"),
        ("a", "runtime", "^1.0.0"), ("y", "development", "1 || 2"), ("z", "optional", "*")}


def test_audit_of_manifests(spark, make_files):
    from fleetsift.plans.audit import scan_files

    files = make_files(("requirements.txt", "Django>=3.0,<4\npinned==1.0\n"), ("package.json", '{"devDependencies": {"left": "^1.0.0"}}'))
    advisories = spark.createDataFrame([("python", "django", "CVE-1", "3.2", "3.5"), ("python", "pinned", "CVE-2", None, "2.0"), ("node", "left", "CVE-3", "1.0.0", "2.0.0")],
                                       "ecosystem string, package string, cve_id string, introduced string, fixed string")
    feed = spark.createDataFrame([("CVE-1", 9.8, "critical", "NETWORK", "NONE", "", ["u"], None)], CVE_FEED)
    raw = spark.createDataFrame([("pinned", "CVE-2")], "package string, cve_id string").selectExpr(
        "1L as scan_id", "'x' as file_path", "'python' as ecosystem", "package", "'1.0' as version", "cve_id", "array('2.0') as fix_versions", "'by the audit' as description", "0 as source_rank", "1 as position")
    found = {(r.package_name, r.cve_id): (r.installed_version, r.fix_suggestion, r.description)
             for r in scan_files(files, advisories=advisories, cve_feed=feed, raw_dependencies=raw).collect()}
    assert found == {("Django", "CVE-1"): (">=3.0,<4", "Upgrade to: Django==3.5", "Some of the versions it allows are affected (runtime)."),
                     ("pinned", "CVE-2"): ("1.0", "Upgrade to: pinned==2.0", "by the audit"),
                     ("left", "CVE-3"): ("^1.0.0", "Upgrade to: left@2.0.0", "Every version it allows is affected (development).")}
