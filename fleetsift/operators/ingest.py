"""Repository files: which are kept, what each one is, and which scans are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift import fixed_values as V
from fleetsift.functions import text


# --- Repository addresses ----------------------------------------------------

def owner_and_name(url: Column) -> tuple[Column, Column]:
    """Owner and repository name: the last two parts; `.git` goes wherever it stands in the name."""
    parts = F.split(F.rtrim(url, F.lit("/")), "/")
    short = F.size(parts) < 2
    owner = F.when(short, "unknown").otherwise(F.try_element_at(parts, F.lit(-2)))
    name = F.when(short, "unknown").otherwise(
        F.replace(F.try_element_at(parts, F.lit(-1)), F.lit(".git"), F.lit("")))
    return owner, name


def with_owner_and_name(repos: DataFrame) -> DataFrame:
    owner, name = owner_and_name(F.col("repo_url"))
    return repos.withColumns({"owner": owner, "repo_name": name})


def short_name(url: Column) -> Column:
    """The last part of the address, as a report heading shows it."""
    return F.try_element_at(F.split(F.rtrim(url, F.lit("/")), "/"), F.lit(-1))


# --- File selection ----------------------------------------------------------

def in_skipped_path(path: Column) -> Column:
    """True if any whole component, the file name included, is one of the skipped names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(c) for c in V.SKIPPED_COMPONENTS]))


def is_relevant(path: Column) -> Column:
    name = text.base_name(path)
    return text.any_of([
        F.lower(text.suffix(path)).isin(V.RELEVANT_SUFFIXES),
        name.isin(V.RELEVANT_NAMES),
        name.startswith(".env"),
        name.contains("Dockerfile"),
    ])


def file_type(path: Column) -> Column:
    ext = F.lower(text.suffix(path))
    return F.when(ext != "", ext).otherwise(text.base_name(path))


def ends_with_yaml(path: Column) -> Column:
    return path.endswith(".yml") | path.endswith(".yaml")


def file_flags(path: Column) -> dict[str, Column]:
    """What kind of file this is.  Names are compared with their case."""
    name = text.base_name(path)
    return {
        "is_workflow": text.slashes(path).contains(V.WORKFLOW_DIRECTORY) & ends_with_yaml(name),
        "is_env_file": name.startswith(".env") | name.isin(V.ENV_FILE_NAMES),
        "is_dockerfile": name.isin(V.DOCKERFILE_NAMES) | name.startswith("Dockerfile."),
        "is_dependency_manifest": name.isin(V.DEPENDENCY_MANIFEST_NAMES),
    }


def select_repo_files(files: DataFrame) -> DataFrame:
    """Drop skipped and irrelevant paths.  Only `path` is read, so contents of dropped rows are not decoded."""
    path = F.col("path")
    return files.filter(~in_skipped_path(path) & is_relevant(path))


def classify_repo_files(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.withColumns({"file_type": file_type(path), **file_flags(path)})


def ingest(files: DataFrame) -> DataFrame:
    return classify_repo_files(select_repo_files(files))


def workflow_files(files: DataFrame) -> DataFrame:
    return files.filter("is_workflow")


def env_files(files: DataFrame) -> DataFrame:
    return files.filter("is_env_file")


def dockerfiles(files: DataFrame) -> DataFrame:
    return files.filter("is_dockerfile")


def dependency_manifests(files: DataFrame) -> DataFrame:
    return files.filter("is_dependency_manifest")


def yaml_files(files: DataFrame) -> DataFrame:
    """All YAML files, not only workflows; the suffix is compared with its case."""
    return files.filter(ends_with_yaml(F.col("path")))


def manifest_ecosystem(path: Column) -> Column:
    """Which audit a manifest goes to; NULL for files that go to none."""
    name = text.base_name(path)
    return (F.when(name == "requirements.txt", "python")
            .when((name == "package.json") & ~path.contains("node_modules"), "node"))


def auditable_manifests(files: DataFrame) -> DataFrame:
    return files.withColumn("ecosystem", manifest_ecosystem(F.col("path"))).filter("ecosystem is not null")


def is_high_risk_name(path: Column) -> Column:
    return text.base_name(path).isin(V.HIGH_RISK_NAMES)


def is_secret_scannable(path: Column) -> Column:
    return F.lower(text.suffix(path)).isin(V.SCANNABLE_SUFFIXES) | is_high_risk_name(path)


def ingest_counts(files: DataFrame) -> DataFrame:
    """Per scan: files kept, workflows, env files, Dockerfiles."""
    return files.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("is_workflow").alias("workflows"),
        F.count_if("is_env_file").alias("env_files"),
        F.count_if("is_dockerfile").alias("dockerfiles"),
    )


# --- Scan requests -----------------------------------------------------------

def validated_requests(requests: DataFrame) -> DataFrame:
    """Trim the address and tell whether it can be scanned."""
    url = F.regexp_replace(F.coalesce(F.col("repo_url"), F.lit("")), r"(?U)^\s+|\s+$", "")
    return requests.withColumns({"repo_url": url, "accepted": url.startswith(V.REPOSITORY_URL_PREFIX)})


def accepted_requests(requests: DataFrame) -> DataFrame:
    return validated_requests(requests).filter("accepted").drop("accepted")


def rejected_requests(requests: DataFrame) -> DataFrame:
    return validated_requests(requests).filter("not accepted").drop("accepted")


SKIP_FLAG = {"secret": "skip_secrets", "misconfig": "skip_misconfigs", "dependency": "skip_deps"}


def drop_skipped_scanners(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """Keep findings whose scanner the request did not switch off; a scan without a request skips nothing."""
    flags = requests.select("scan_id", *SKIP_FLAG.values())
    joined = findings.join(flags, "scan_id", "left")
    skipped = F.lit(False)
    for finding_type, flag in SKIP_FLAG.items():
        skipped = skipped | ((F.col("finding_type") == finding_type) & F.coalesce(F.col(flag), F.lit(False)))
    return joined.filter(~skipped).drop(*SKIP_FLAG.values())


def files_to_scan(files: DataFrame, requests: DataFrame, scanner: str) -> DataFrame:
    """Files of the scans that want `scanner`, to save the scanner's work.

    Spark broadcasts the switched-off scan ids if they are few by its own
    measure; no job runs while the plan is built.
    """
    off = requests.filter(F.col(SKIP_FLAG[scanner])).select("scan_id").distinct()
    return files.join(off, "scan_id", "left_anti")
