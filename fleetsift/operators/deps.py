"""Vulnerable dependencies: union, dedupe, CVE lookup, fix advice, and advisory matching.

Order matters for cost: duplicates go before the lookup join, and every
grouping keeps its first row by a partial aggregate, so a package that holds a
large share of all rows is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift.functions import specifiers, text, versions
from fleetsift.functions.first import first_per_group
from fleetsift.operators import ingest
from fleetsift.schemas import FINDINGS, conform

# Python before node, then by file, then by place in the report.
RAW_ORDER = ["source_rank", "file_path", "position"]


def union_raw(python: DataFrame, node: DataFrame) -> DataFrame:
    """Both audits' raw vulnerabilities; `source_rank` puts Python first."""
    return (python.withColumn("source_rank", F.lit(0))
            .unionByName(node.withColumn("source_rank", F.lit(1))))


def cve_key(cve_id: Column, package: Column) -> Column:
    return F.coalesce(text.blank_to_null(cve_id), F.concat(F.lit("NO-CVE-"), package))


def with_cve_key(raw: DataFrame) -> DataFrame:
    return raw.withColumn("cve_id", cve_key(F.col("cve_id"), F.col("package")))


def first_per_cve_and_package(raw: DataFrame, order: Sequence[str] = RAW_ORDER) -> DataFrame:
    """One row per (scan, CVE, package), the first in order, across files and ecosystems."""
    return first_per_group(raw, ["scan_id", "cve_id", "package"], order)


def with_cve_details(vulns: DataFrame, feed: DataFrame) -> DataFrame:
    """Left join to the CVE feed.  Only ids that begin `CVE-` are looked up.

    A CVE the feed lacks scores 0 with severity UNKNOWN; an id that is no CVE
    is MEDIUM.  `feed` has one row per CVE; Spark decides from its size
    whether to broadcast it.
    """
    details = feed.filter(F.col("cve_id").startswith("CVE-")).select(
        "cve_id",
        F.col("base_score").alias("feed_score"), F.col("severity").alias("feed_severity"),
        F.col("attack_vector").alias("feed_vector"), F.col("description").alias("feed_description"),
        F.col("references").alias("feed_references"), F.lit(True).alias("found"))
    is_cve = F.col("cve_id").startswith("CVE-")
    severity = (F.when(~is_cve, "MEDIUM")
                .when(F.col("found"), F.coalesce(text.blank_to_null(F.col("feed_severity")), F.lit("MEDIUM")))
                .otherwise("UNKNOWN"))
    return vulns.join(details, "cve_id", "left").withColumns({
        "base_score": F.coalesce("feed_score", F.lit(0.0)),
        "rule_severity": F.upper(severity),
        "attack_vector": F.coalesce("feed_vector", F.lit("UNKNOWN")),
        "references": F.coalesce("feed_references", F.array().cast("array<string>")),
        "description": F.coalesce(text.blank_to_null(F.col("feed_description")), F.col("description"), F.lit("")),
    }).drop("feed_score", "feed_severity", "feed_vector", "feed_description", "feed_references", "found")


def fixed_version(fix_versions: Column) -> Column:
    return F.coalesce(F.try_element_at(fix_versions, F.lit(1)), F.lit("N/A"))


def fix_advice(package: Column, ecosystem: Column, fix: Column) -> Column:
    separator = F.when(ecosystem == "python", "==").otherwise("@")
    return (F.when(fix == "N/A", "No fix available yet.")
            .otherwise(F.concat(F.lit("Upgrade to: "), package, separator, fix)))


def with_fix(vulns: DataFrame) -> DataFrame:
    return (vulns.withColumn("fixed_version", fixed_version(F.col("fix_versions")))
            .withColumn("fix_suggestion", fix_advice(F.col("package"), F.col("ecosystem"), F.col("fixed_version"))))


def dependency_findings(raw: DataFrame, feed: DataFrame, order: Sequence[str] = RAW_ORDER) -> DataFrame:
    """Raw vulnerabilities of both audits -> findings table rows."""
    unique = first_per_cve_and_package(with_cve_key(raw), order)
    detailed = with_fix(with_cve_details(unique, feed))
    return conform(detailed.withColumnsRenamed({"package": "package_name", "version": "installed_version"}).withColumns({
        "scanner_rank": F.lit(2),
        "item_index": F.lit(0),
        "finding_type": F.lit("dependency"),
        "rule_id": F.concat(F.lit("DEP-"), F.col("cve_id")),
    }), FINDINGS)


# --- Declared versions against advisories -------------------------------------

_REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*==\s*([A-Za-z0-9.!+_-]+)"
_PACKAGE_JSON = "dependencies map<string,string>"


def declared_dependencies(manifests: DataFrame) -> DataFrame:
    """Manifest files -> (scan_id, file_path, ecosystem, package, version).

    Reads `name==version` lines of requirements.txt and `dependencies` of
    package.json (a leading `^`, `~`, `=` or `v` of the version is dropped).
    """
    known = ingest.auditable_manifests(manifests)
    lines = (known.filter("ecosystem = 'python'")
             .select("scan_id", "path", "ecosystem", F.explode(text.lines(F.col("content"))).alias("line"))
             .filter(F.col("line").rlike(_REQUIREMENT))
             .select("scan_id", "path", "ecosystem",
                     F.regexp_extract("line", _REQUIREMENT, 1).alias("package"),
                     F.regexp_extract("line", _REQUIREMENT, 2).alias("version")))
    entries = (known.filter("ecosystem = 'node'")
               .select("scan_id", "path", "ecosystem",
                       F.explode(F.from_json("content", _PACKAGE_JSON)["dependencies"]).alias("package", "range"))
               .select("scan_id", "path", "ecosystem", "package",
                       F.regexp_replace("range", r"^[\^~=v\s]+", "").alias("version")))
    return lines.unionByName(entries).withColumnRenamed("path", "file_path")


def match_advisories(declared: DataFrame, advisories: DataFrame) -> DataFrame:
    """Declared dependencies with `introduced <= version < fixed` for some advisory.

    One row per (scan, file, ecosystem, package, version, CVE), with the lowest
    fixed version that clears it; NULL where no version does yet.  An advisory
    without `introduced` holds from the first version on.  Python packages are
    told apart by their normalized names.  The range test runs over the distinct
    versions of each package, of which there are few however many repositories
    declare them, and its result is joined back by equality.  Versions that are
    not plain match nothing; `unparsed_versions` lists them.
    """
    entries = declared.select("scan_id", "file_path", "ecosystem", "package", "version").distinct().withColumn("name", _normal_name())
    distinct_versions = (entries.select("ecosystem", "name", "version").distinct()
                         .withColumn("v", versions.version_key(F.col("version"))).filter("v is not null"))
    affected = (distinct_versions.join(_advisory_ranges(advisories), ["ecosystem", "name"])
                .filter((F.col("low").isNull() | (F.col("low") <= F.col("v"))) & (F.col("high").isNull() | (F.col("v") < F.col("high"))))
                .groupBy("ecosystem", "name", "version", "cve_id")
                .agg(_lowest_fixed()))
    return entries.join(affected, ["ecosystem", "name", "version"]).select(
        "ecosystem", "package", "version", "scan_id", "file_path", "cve_id", "fixed")


def _advisory_ranges(advisories: DataFrame) -> DataFrame:
    """Distinct advisories with the keys of their bounds; those with a bound that is no plain version are left out."""
    return (advisories.select("ecosystem", _normal_name().alias("name"), "cve_id", "introduced", "fixed").distinct()
            .withColumns({"low": versions.version_key(F.col("introduced")), "high": versions.version_key(F.col("fixed"))})
            .filter("(introduced is null or low is not null) and (fixed is null or high is not null)"))


def _lowest_fixed() -> Column:
    return F.min_by("fixed", F.struct(F.col("fixed").isNull(), "high", "fixed")).alias("fixed")


def _normal_name() -> Column:
    python = F.lower(F.regexp_replace("package", "[-_.]+", "-"))
    return F.when(F.col("ecosystem") == "python", python).otherwise(F.col("package"))


def unparsed_versions(declared: DataFrame) -> DataFrame:
    return declared.filter(~versions.is_plain(F.col("version")))


def raw_from_advisories(matches: DataFrame) -> DataFrame:
    """Advisory matches in the form of raw vulnerabilities, for `dependency_findings`."""
    return matches.select(
        "scan_id", "file_path", "ecosystem", "package", "version", "cve_id",
        F.array_compact(F.array("fixed")).alias("fix_versions"), F.lit("").alias("description"),
        F.when(F.col("ecosystem") == "python", 0).otherwise(1).alias("source_rank"),
        F.struct("version", "fixed").alias("position"))


# --- Version specifiers against advisories -------------------------------------

_NOT_IN_LINE = r"(^|\s)#.*$|\s--?[a-z].*$|;.*$"
_NAMED = r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*((?:[=<>!~(@].*)?)$"
#: Sections of package.json and the scope of what they list.
NODE_SECTIONS = {"dependencies": "runtime", "devDependencies": "development", "optionalDependencies": "optional"}


def declared_specifiers(manifests: DataFrame) -> DataFrame:
    """Manifest files -> (scan_id, file_path, ecosystem, package, scope, specifier), all entries of them.

    Lines of requirements.txt with any specifier or none, without comments, markers and options;
    lines that are options only are left out.  `dependencies`, `devDependencies` and
    `optionalDependencies` of package.json, the specifier as it is written.
    """
    known = ingest.auditable_manifests(manifests)
    joined = F.regexp_replace(text.newline_breaks(F.col("content")), r"\\\n", " ")
    lines = (known.filter("ecosystem = 'python'")
             .select("scan_id", "path", "ecosystem", F.explode(F.split(joined, "\n")).alias("line"))
             .withColumn("line", F.rtrim(F.regexp_replace("line", _NOT_IN_LINE, "")))
             .filter(F.col("line").rlike(_NAMED))
             .select("scan_id", "path", "ecosystem", F.regexp_extract("line", _NAMED, 1).alias("package"), F.lit("runtime").alias("scope"),
                     F.trim(F.translate(F.regexp_extract("line", _NAMED, 2), "()", "")).alias("specifier")))
    document = F.from_json("content", ", ".join(f"{name} map<string,string>" for name in NODE_SECTIONS))
    sections = F.map_from_arrays(F.array(*[F.lit(scope) for scope in NODE_SECTIONS.values()]),
                                 F.array(*[F.col("document")[name] for name in NODE_SECTIONS]))
    entries = (known.filter("ecosystem = 'node'").withColumn("document", document)
               .select("scan_id", "path", "ecosystem", F.explode(sections).alias("scope", "entries"))
               .select("scan_id", "path", "ecosystem", F.explode("entries").alias("package", "specifier"), "scope"))
    return lines.unionByName(entries).withColumnRenamed("path", "file_path")


def match_specifiers(declared: DataFrame, advisories: DataFrame) -> DataFrame:
    """Declared specifiers that allow a version with `introduced <= version < fixed` for some advisory.

    One row per (scan, file, ecosystem, package, scope, specifier, CVE).  `is_range` tells a
    specifier that allows more than one version from a pin; `certain` that one advisory holds all
    versions it allows.  `fixed` is the lowest fixed version of the advisories it meets, NULL where
    none has one.  Intervals are read and met over the distinct specifiers of each package and
    joined back by equality.  Specifiers that are not understood match nothing;
    `unmatched_specifiers` lists them.
    """
    entries = (declared.select("scan_id", "file_path", "ecosystem", "package", "scope", "specifier").distinct()
               .withColumn("name", _normal_name()))
    allowed = (entries.select("ecosystem", "name", "specifier").distinct()
               .withColumn("allowed", specifiers.intervals(F.col("ecosystem"), F.col("specifier"))).filter("allowed is not null")
               .withColumn("is_range", ~specifiers.is_single(F.col("allowed"))))
    ranges = _advisory_ranges(advisories)

    def below(a: Column, b: Column) -> Column:
        return F.coalesce(a < b, F.lit(True))

    def inside(i: Column) -> Column:
        return (F.col("low").isNull() | F.coalesce(F.col("low") <= i["low"], F.lit(False))) & (
            F.col("high").isNull() | F.coalesce(i["high"] <= F.col("high"), F.lit(False)))

    affected = (allowed.join(ranges, ["ecosystem", "name"])
                .filter(F.exists("allowed", lambda i: below(i["low"], F.col("high")) & below(F.col("low"), i["high"])))
                .withColumn("certain", F.forall("allowed", inside))
                .groupBy("ecosystem", "name", "specifier", "is_range", "cve_id")
                .agg(_lowest_fixed(), F.max("certain").alias("certain")))
    return entries.join(affected, ["ecosystem", "name", "specifier"]).select(
        "scan_id", "file_path", "ecosystem", "package", "scope", "specifier", "cve_id", "is_range", "certain", "fixed")


def unmatched_specifiers(declared: DataFrame) -> DataFrame:
    """Entries whose specifier is not understood (addresses, tags, odd versions): no advisory was held against them."""
    kinds = (declared.select("ecosystem", "specifier").distinct()
             .filter(specifiers.intervals(F.col("ecosystem"), F.col("specifier")).isNull()))
    same = declared["specifier"].eqNullSafe(kinds["specifier"]) & (declared["ecosystem"] == kinds["ecosystem"])
    return declared.join(kinds, same, "left_semi")


def raw_from_specifiers(matches: DataFrame) -> DataFrame:
    """Specifier matches in the form of raw vulnerabilities, for `dependency_findings`."""
    kind = F.when(F.col("certain"), "Every version it allows is affected").otherwise("Some of the versions it allows are affected")
    return matches.select(
        "scan_id", "file_path", "ecosystem", "package", F.col("specifier").alias("version"), "cve_id",
        F.array_compact(F.array("fixed")).alias("fix_versions"),
        F.when(F.col("is_range"), F.concat(kind, F.lit(" ("), "scope", F.lit(")."))).otherwise("").alias("description"),
        F.when(F.col("ecosystem") == "python", 0).otherwise(1).alias("source_rank"),
        F.struct("specifier", "scope", "fixed").alias("position"))


def not_reported(matches: DataFrame, raw: DataFrame) -> DataFrame:
    """Matches without those that an external audit reported for the same scan, CVE and package."""
    reported = with_cve_key(raw).select("scan_id", "cve_id", "package").distinct()
    return matches.join(reported, ["scan_id", "cve_id", "package"], "left_anti")


# --- The CVE table ------------------------------------------------------------

def upsert_cves(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per CVE, the last fetched; of two fetched at once, the greater row."""
    both = current.unionByName(incoming)
    rest = [c for c in both.columns if c not in ("cve_id", "fetched_at")]
    latest = both.groupBy("cve_id").agg(F.max(F.struct("fetched_at", *rest)).alias("row"))
    return latest.select("cve_id", "row.*").select(*both.columns)


def lookup_cves(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Look ids up in the CVE table; an id it lacks is a miss.  Entries never expire."""
    hits = table.withColumn("hit", F.lit(True))
    return ids.join(hits, "cve_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
