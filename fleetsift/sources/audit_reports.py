"""JSON reports of dependency audits and static analysis, one report per row, flattened to tables.

Input columns: scan_id, file_path, body.  A body that is no JSON gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsift import fixed_values as V

PYTHON_REPORT = (
    "dependencies array<struct<name:string,version:string,"
    "vulns:array<struct<id:string,fix_versions:array<string>,description:string>>>>"
)
NODE_REPORT = "vulnerabilities map<string,struct<`range`:string,fixAvailable:string,via:array<string>>>"
STATIC_REPORT = (
    "results array<struct<check_id:string,path:string,start:struct<line:bigint>,"
    "extra:struct<severity:string,message:string>>>"
)
CVE_RESPONSE = (
    "vulnerabilities array<struct<cve:struct<id:string,"
    "metrics:struct<"
    "cvssMetricV31:array<struct<cvssData:struct<baseScore:double,baseSeverity:string,attackVector:string,privilegesRequired:string>>>,"
    "cvssMetricV30:array<struct<cvssData:struct<baseScore:double,baseSeverity:string,attackVector:string,privilegesRequired:string>>>>,"
    "descriptions:array<struct<lang:string,value:string>>,"
    "`references`:array<struct<url:string>>>>>"
)


def _or_empty(value):
    return F.coalesce(value, F.lit(""))


def python_audit(reports: DataFrame) -> DataFrame:
    """dependencies[] x vulns[]: one row per known vulnerability of a Python dependency."""
    deps = (reports.select("scan_id", "file_path", F.from_json("body", PYTHON_REPORT).alias("r"))
            .select("scan_id", "file_path", F.posexplode("r.dependencies").alias("dep_no", "dep")))
    vulns = deps.select("scan_id", "file_path", "dep_no", "dep.name", "dep.version",
                        F.posexplode("dep.vulns").alias("vuln_no", "vuln"))
    return vulns.select(
        "scan_id", "file_path", F.lit("python").alias("ecosystem"),
        F.struct("dep_no", "vuln_no").alias("position"),
        _or_empty(F.col("name")).alias("package"),
        _or_empty(F.col("version")).alias("version"),
        _or_empty(F.col("vuln.id")).alias("cve_id"),
        F.coalesce("vuln.fix_versions", F.array().cast("array<string>")).alias("fix_versions"),
        _or_empty(F.col("vuln.description")).alias("description"),
    )


def node_audit(reports: DataFrame) -> DataFrame:
    """vulnerabilities{} x via[]: one row per advisory object; plain names in `via` are skipped.

    `fix_versions` holds the version the fix object names, or `True` where the
    report only says that a fix exists.
    """
    packages = (reports.select("scan_id", "file_path", F.from_json("body", NODE_REPORT).alias("r"))
                .select("scan_id", "file_path", F.posexplode("r.vulnerabilities").alias("dep_no", "package", "v")))
    vias = packages.select("scan_id", "file_path", "dep_no", "package", "v.range", "v.fixAvailable",
                           F.posexplode("v.via").alias("vuln_no", "via")).filter(F.col("via").startswith("{"))
    fix = F.col("fixAvailable")
    fix_version = (F.when(fix.startswith("{"), F.get_json_object(fix, "$.version"))
                   .when(fix == "true", "True")
                   .when(fix.isin("false", "null", "", "0", "[]"), None)
                   .otherwise(fix))
    return vias.select(
        "scan_id", "file_path", F.lit("node").alias("ecosystem"),
        F.struct("dep_no", "vuln_no").alias("position"),
        "package",
        _or_empty(F.col("range")).alias("version"),
        _or_empty(F.get_json_object("via", "$.cve[0]")).alias("cve_id"),
        F.array_compact(F.array(fix_version)).alias("fix_versions"),
        _or_empty(F.get_json_object("via", "$.title")).alias("description"),
    )


def cve_feed(responses: DataFrame) -> DataFrame:
    """CVE database answers -> one row per CVE.  Input columns: cve_id (may be NULL), body, fetched_at.

    An answer to a request for one id counts for that id, by its first entry.
    A bulk file (cve_id NULL) counts for every entry, by the entry's own id.
    """
    entries = (responses
               .select("cve_id", "fetched_at", F.from_json("body", CVE_RESPONSE)["vulnerabilities"].alias("v"))
               .withColumn("v", F.when(F.col("cve_id").isNotNull(), F.slice("v", 1, 1)).otherwise(F.col("v")))
               .select("cve_id", "fetched_at", F.explode("v.cve").alias("cve")))
    first = F.coalesce(F.try_element_at("cve.metrics.cvssMetricV31", F.lit(1)),
                       F.try_element_at("cve.metrics.cvssMetricV30", F.lit(1)))["cvssData"]
    english = F.filter("cve.descriptions", lambda d: d["lang"] == "en")
    urls = F.transform(F.slice("cve.references", 1, V.FIRST_REFERENCES), lambda r: r["url"])
    return entries.select(
        F.coalesce("cve_id", "cve.id").alias("cve_id"),
        F.coalesce(first["baseScore"], F.lit(0.0)).alias("base_score"),
        F.coalesce(first["baseSeverity"], F.lit("UNKNOWN")).alias("severity"),
        F.coalesce(first["attackVector"], F.lit("UNKNOWN")).alias("attack_vector"),
        F.coalesce(first["privilegesRequired"], F.lit("UNKNOWN")).alias("privileges_required"),
        _or_empty(F.try_element_at(english, F.lit(1))["value"]).alias("description"),
        F.coalesce(urls, F.array().cast("array<string>")).alias("references"),
        "fetched_at",
    )


def static_analysis(reports: DataFrame) -> DataFrame:
    """External static-analysis results as misconfiguration findings.

    Input columns: scan_id, root, body.  Paths below `root` are made relative to it.
    """
    results = (reports.select("scan_id", "root", F.from_json("body", STATIC_REPORT)["results"].alias("results"))
               .select("scan_id", "root", F.posexplode("results").alias("item_index", "r")))
    path = F.coalesce("r.path", F.lit("unknown"))
    prefix = F.concat(F.rtrim(F.col("root"), F.lit("/")), F.lit("/"))
    relative = F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)
    check = F.col("r.check_id")
    return results.select(
        "scan_id",
        F.lit(1).alias("scanner_rank"),
        F.col("item_index").cast("bigint").alias("item_index"),
        F.concat(F.lit("SG-"), F.replace(F.coalesce(check, F.lit("UNKNOWN")), F.lit("."), F.lit("-"))).alias("rule_id"),
        F.coalesce(check, F.lit("Semgrep Finding")).alias("rule_name"),
        relative.alias("file_path"),
        F.coalesce("r.start.line", F.lit(1)).cast("bigint").alias("line_number"),
        F.lit("misconfig").alias("finding_type"),
        F.upper(F.coalesce("r.extra.severity", F.lit("MEDIUM"))).alias("rule_severity"),
        F.coalesce("r.extra.message", F.lit("Semgrep rule match")).alias("description"),
        F.lit("semgrep").alias("source"),
        F.array().cast("array<string>").alias("affected_triggers"),
    )
