"""SARIF 2.1 output: one JSON object per result, and whole documents per scan.

A document is written as lines: a head, one line per rule and per result, a tail.  Lines of large scans get their
places by counting, so a scan of any size is one document and no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetsift import __version__
from fleetsift import fixed_values as V
from fleetsift.functions import severity as sev
from fleetsift.functions import text
from fleetsift.functions.spread import heavy_keys, numbered, numbered_in_ranges, shuffle_tasks, tasks_for
from fleetsift.operators.report import rule_columns, rule_definitions
from fleetsift.plans.session import working_directory
from fleetsift.schemas import FINDING_ORDER

# What stands where in a document.
HEAD, RULES, MIDDLE, RESULTS, TAIL = range(5)


def reference_of() -> Column:
    return F.coalesce(text.blank_to_null(F.col("cve_reference")), text.blank_to_null(F.col("cve_id")))


def line_or_first(line: Column) -> Column:
    return F.coalesce(F.nullif(line, F.lit(0)), F.lit(1)).cast("bigint")


def source_root(repo_url: Column) -> Column:
    return F.concat(repo_url, F.lit("/blob/HEAD/"))


def result_struct() -> Column:
    """A SARIF result; fields that are NULL are left out by `to_json`."""
    severity = F.coalesce("severity", F.lit("MEDIUM"))
    return F.struct(
        F.coalesce("rule_id", F.lit("UNKNOWN")).alias("ruleId"),
        sev.sarif_level(severity).alias("level"),
        F.struct(F.coalesce("description", F.lit("Finding detected")).alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(text.slashes(F.coalesce("file_path", F.lit("unknown"))).alias("uri"),
                     F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
            F.struct(line_or_first(F.col("line_number")).alias("startLine"), F.lit(1).alias("startColumn")).alias("region"),
        ).alias("physicalLocation"))).alias("locations"),
        F.struct(
            severity.alias("severity"),
            F.coalesce("risk_score", F.lit(0.0)).alias("riskScore"),
            F.coalesce("finding_type", F.lit("unknown")).alias("findingType"),
            text.blank_to_null(F.col("fix_suggestion")).alias("fixSuggestion"),
            reference_of().alias("cveReference"),
        ).alias("properties"))


def results_json(scored: DataFrame) -> DataFrame:
    """One JSON text per finding.  Row by row, so it suits scans of any size."""
    return scored.select("scan_id", F.to_json(result_struct()).alias("result"))


def _rule_struct(rule: dict[str, Column] | None = None) -> Column:
    rule = rule or {name: F.col(name) for name in rule_columns()}
    return F.struct(
        rule["rule_id"].alias("id"), rule["name"].alias("name"),
        F.struct(rule["short_description"].alias("text")).alias("shortDescription"),
        F.struct(rule["full_description"].alias("text")).alias("fullDescription"),
        F.struct(rule["level"].alias("level")).alias("defaultConfiguration"),
        rule["help_uri"].alias("helpUri"))


def _needed(order: Sequence[str]) -> list[str]:
    """Columns of findings that documents are made of.  They travel, not the longer JSON texts made of them."""
    return [*dict.fromkeys([*order, "rule_id", "rule_name", "severity", "description", "file_path", "line_number", "risk_score", "finding_type",
                            "fix_suggestion", "cve_reference", "cve_id"])]


def _shows_rule(by: Sequence[str], order: Sequence[str]) -> Column:
    """Whether a finding is the one that shows its rule: the first in risk order, as in `rule_definitions`."""
    rule = rule_columns()
    same_rule = Window.partitionBy(*by, "is_scan", rule.pop("rule_id")).orderBy(-F.col("risk_score"), *order, *rule.values())
    return ~F.col("is_scan") & (F.row_number().over(same_rule) == 1)


def document_lines(scored: DataFrame, scans: DataFrame, *, tool_name: str = "fleetsift", tool_version: str = __version__,
                   information_uri: str = "https://example.com/fleetsift", order: Sequence[str] = FINDING_ORDER) -> DataFrame:
    """(scan_id, section, line_no, line): the lines of one document for every scan, empty ones included.

    Read in the order of section and line_no, the lines of a scan are its document.  Results and rules
    stand in risk order.  One shuffle brings the findings of a scan together with its row, and lines come
    out dealt by scan_id.  Only scans above a task's even share are counted and numbered in ranges, so a scan with most
    of all findings is spread over all tasks.  `scans` brings repo_url and scanned_at.
    """
    found = scored.filter("scan_id is not null").select("scan_id", *[c for c in _needed(order) if c != "scan_id"])
    ends = scans.select("scan_id", "repo_url", "scanned_at")
    # Whole JSON texts of the parts around the lists, cut where the lists stand.
    tool = F.to_json(F.struct(F.lit(tool_name).alias("name"), F.lit(tool_version).alias("version"), F.lit(information_uri).alias("informationUri")))
    start = F.to_json(F.struct(F.lit(V.SARIF_SCHEMA).alias("$schema"), F.lit(V.SARIF_VERSION).alias("version")))
    open_object = lambda text: F.substring(text, 1, F.length(text) - 1)
    roots = F.to_json(F.struct(F.struct(source_root(F.col("repo_url")).alias("uri")).alias("%SRCROOT%")))
    properties = F.to_json(F.struct(F.date_format("scanned_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("scannedAt"),
                                    F.col("repo_url").alias("repoUrl"), F.col("total").alias("totalFindings")))
    pieces = F.array(
        F.struct(F.lit(HEAD).alias("section"), F.lit(1).cast("bigint").alias("line_no"), F.concat(open_object(start), F.lit(',"runs":[{"tool":{"driver":'), open_object(tool), F.lit(',"rules":[')).alias("line")),
        F.struct(F.lit(MIDDLE).alias("section"), F.lit(1).cast("bigint").alias("line_no"), F.concat(F.lit(']}},"originalUriBaseIds":'), roots, F.lit(',"results":[')).alias("line")),
        F.struct(F.lit(TAIL).alias("section"), F.lit(1).cast("bigint").alias("line_no"), F.concat(F.lit('],"properties":'), properties, F.lit("}]}")).alias("line")))
    heavy = list(heavy_keys(found, ["scan_id"], shuffle_tasks(found)))
    if not heavy:
        return _lines_of_whole_scans(found, ends, pieces, order)
    is_heavy = F.xxhash64("scan_id").isin(heavy)
    return (_lines_of_whole_scans(found.filter(~is_heavy), ends.filter(~is_heavy), pieces, order)
            .union(_lines_in_ranges(found.filter(is_heavy), ends.filter(is_heavy), pieces, order)))


def _entry(section: int, number: str, entry: Column) -> Column:
    comma = F.when(F.col(number) > 1, ",").otherwise("")
    return F.struct(F.lit(section).alias("section"), F.col(number).alias("line_no"), F.concat(comma, F.to_json(entry)).alias("line"))


def _lines_of_whole_scans(found: DataFrame, ends: DataFrame, pieces: Column, order: Sequence[str]) -> DataFrame:
    dealt = (found.withColumn("is_scan", F.lit(False)).unionByName(ends.withColumn("is_scan", F.lit(True)), allowMissingColumns=True)
             .repartition(tasks_for(found), "scan_id").withColumn("shows_rule", _shows_rule(["scan_id"], order)))
    # Findings first: what runs along them is the total where the scan's own row stands.
    so_far = Window.partitionBy("scan_id").orderBy("is_scan", -F.col("risk_score"), *order, rule_columns()["rule_id"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumns({"line_no": F.row_number().over(so_far).cast("bigint"), "rule_no": F.sum(F.col("shows_rule").cast("bigint")).over(so_far),
                                "total": F.sum((~F.col("is_scan")).cast("bigint")).over(so_far)})
    result, rule = _entry(RESULTS, "line_no", result_struct()), _entry(RULES, "rule_no", _rule_struct(rule_columns()))
    lines = F.when(F.col("is_scan"), pieces).when(F.col("shows_rule"), F.array(rule, result)).otherwise(F.array(result))
    return placed.select("scan_id", F.inline(lines))


def _lines_in_ranges(found: DataFrame, ends: DataFrame, pieces: Column, order: Sequence[str]) -> DataFrame:
    spark = found.sparkSession
    results = numbered_in_ranges(found.withColumn("_risk_order", -F.col("risk_score")), ["scan_id"], ["_risk_order", *order], "line_no", working_directory(spark, "results"))
    rules = numbered(rule_definitions(found, order), ["scan_id"], ["first_seen"], "line_no", working_directory(spark, "rules"))
    totals = found.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total"))
    framed = ends.join(totals, "scan_id", "left").withColumn("total", F.coalesce("total", F.lit(0))).select("scan_id", F.inline(pieces))
    return (framed.union(rules.select("scan_id", F.inline(F.array(_entry(RULES, "line_no", _rule_struct())))))
            .union(results.select("scan_id", F.inline(F.array(_entry(RESULTS, "line_no", result_struct()))))))


def documents(scored: DataFrame, scans: DataFrame, *, tool_name: str = "fleetsift", tool_version: str = __version__,
              information_uri: str = "https://example.com/fleetsift", order: Sequence[str] = FINDING_ORDER,
              results_per_document: int | None = None) -> DataFrame:
    """(scan_id, part, parts, document) for every scan, empty ones included: each document as one text, for scans that fit in a row.

    With `results_per_document` a scan with more findings is split by a hash of the finding into
    documents that each stand alone.  `document_lines` has no such bounds.  `scans` brings repo_url
    and scanned_at.
    """
    found = scored.filter("scan_id is not null").select("scan_id", *[c for c in _needed(order) if c != "scan_id"])
    ends = scans.select("scan_id", "repo_url", "scanned_at")
    if results_per_document is None:
        placed = found.withColumn("part", F.lit(0))
        parts = ends.withColumns({"total": F.lit(None).cast("bigint"), "parts": F.lit(1), "part": F.lit(0)})
    else:
        totals = found.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total"))
        # Hashed parts are not exactly equal; half-full parts leave room.
        pieces = F.when(F.col("total") <= results_per_document, F.lit(1)).otherwise(F.ceil(F.col("total") / (results_per_document / 2))).cast("int")
        part = F.pmod(F.xxhash64("rule_id", *order, "description"), F.col("parts")).cast("int")
        placed = found.join(totals.select("scan_id", pieces.alias("parts")), "scan_id").withColumn("part", part).drop("parts")
        parts = (ends.join(totals, "scan_id", "left").withColumns({"total": F.coalesce("total", F.lit(0)), "parts": F.coalesce(pieces, F.lit(1))})
                 .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))

    # One shuffle brings the findings of a document together with the row of its scan.
    dealt = (placed.withColumn("is_scan", F.lit(False)).unionByName(parts.withColumn("is_scan", F.lit(True)), allowMissingColumns=True)
             .repartition(tasks_for(found), "scan_id", "part").withColumn("shows_rule", _shows_rule(["scan_id", "part"], order)))
    rule = rule_columns()
    sort_key = [(-F.col("risk_score")).alias("risk"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]]
    grouped = dealt.groupBy("scan_id", "part").agg(
        F.sort_array(F.collect_list(F.when(~F.col("is_scan"), F.struct(F.struct(*sort_key).alias("key"), result_struct().alias("result"))))).alias("results"),
        F.sort_array(F.collect_list(F.when(F.col("shows_rule"), F.struct(F.struct(*sort_key, rule["rule_id"]).alias("first_seen"), _rule_struct(rule).alias("rule"))))).alias("rules"),
        F.collect_list(F.when(F.col("is_scan"), F.struct("repo_url", "scanned_at", "parts", "total"))).alias("scans"))
    # A scan that comes twice has a document for each row, and each result in it as often.
    times = F.size("scans")
    listed = F.transform("results", lambda x: x["result"])
    joined = grouped.select("scan_id", "part", F.when(times > 1, F.flatten(F.transform(listed, lambda x: F.array_repeat(x, times)))).otherwise(listed).alias("results"),
                            F.transform("rules", lambda x: x["rule"]).alias("rules"), F.size("results").cast("bigint").alias("found"), F.inline("scans"))
    joined = joined.withColumn("total", F.coalesce("total", "found"))
    run = F.struct(
        F.struct(F.struct(
            F.lit(tool_name).alias("name"), F.lit(tool_version).alias("version"),
            F.lit(information_uri).alias("informationUri"),
            F.coalesce("rules", F.array()).alias("rules")).alias("driver")).alias("tool"),
        F.struct(F.struct(source_root(F.col("repo_url")).alias("uri")).alias("%SRCROOT%")).alias("originalUriBaseIds"),
        F.coalesce("results", F.array()).alias("results"),
        F.struct(
            F.date_format("scanned_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("scannedAt"),
            F.col("repo_url").alias("repoUrl"), F.col("total").alias("totalFindings")).alias("properties"))
    document = F.to_json(F.struct(
        F.lit(V.SARIF_SCHEMA).alias("$schema"), F.lit(V.SARIF_VERSION).alias("version"), F.array(run).alias("runs")))
    return joined.select("scan_id", "part", "parts", document.alias("document"))


def write_documents(lines: DataFrame, path: str) -> None:
    """Text files in a directory per scan range, so directory counts stay bounded; in order of their names they hold one document after the other.

    Spread by range first: a task writes neighbouring scans, so to few
    directories, and the lines of a very large scan come from many tasks.
    """
    # Sorted by the directory first: the writer would sort by it anew otherwise, and mix up lines.
    (lines.withColumn("scan_range", F.floor(F.col("scan_id") / 10_000)).repartitionByRange("scan_id", "section", "line_no")
     .sortWithinPartitions("scan_range", "scan_id", "section", "line_no")
     .select("scan_range", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("scan_range").text(path))
