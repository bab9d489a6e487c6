"""Structural workflow rules: same form as the rules in `misconfig`, other severities, no triggers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetsift import fixed_values as V
from fleetsift.functions import text
from fleetsift.operators import misconfig
from fleetsift.operators.misconfig import hits_if, steps_with_job


def _hit(check: str, line: Column) -> Column:
    severity, message = V.STRUCTURAL_RULES[check]
    return misconfig.hit("SG-" + check, check, line, severity, F.lit(message), source="semgrep",
                         triggers=F.array().cast("array<string>"))


def _line_of(needle: str) -> Column:
    return misconfig.line_of(F.lit(needle))


def _interpolated_in_run(check: str, context: str) -> Column:
    pattern = r"\$\{\{\s*" + context.replace(".", r"\.") + r"\s*\}\}"
    found = F.filter(steps_with_job(), lambda s: F.coalesce(s["step"]["run"].rlike(pattern), F.lit(False)))
    return F.transform(found, lambda _: _hit(check, _line_of(context)))


def title_in_run() -> Column:
    return _interpolated_in_run("cicd-script-injection-pr-title", "github.event.pull_request.title")


def issue_body_in_run() -> Column:
    return _interpolated_in_run("cicd-script-injection-issue-body", "github.event.issue.body")


def _is_write_all(perms_str: Column) -> Column:
    return F.coalesce(perms_str == "write-all", F.lit(False))


def target_with_write_all() -> Column:
    return hits_if(
        F.array_contains("triggers", "pull_request_target") & _is_write_all(F.col("perms_str")),
        F.array(_hit("cicd-prt-write-all", _line_of("pull_request_target"))))


def _matching_lines(check: str, pattern: str) -> Column:
    numbered = F.transform(F.split("broken", "\n"), lambda line, i: F.struct(line.alias("line"), (i + 1).alias("number")))
    found = F.filter(numbered, lambda n: n["line"].rlike(text.regex(pattern)))
    return F.transform(found, lambda n: _hit(check, n["number"].cast("bigint")))


def tag_pinned() -> Column:
    return _matching_lines("cicd-unpinned-action-tag", V.TAG_PINNED_PATTERN)


def branch_pinned() -> Column:
    return _matching_lines("cicd-unpinned-action-branch", V.BRANCH_PINNED_PATTERN)


def write_all_token() -> Column:
    levels = F.concat(F.array(F.col("perms_str")), F.transform("jobs", lambda job: job["perms_str"]))
    return F.transform(F.filter(levels, _is_write_all), lambda _: _hit("cicd-token-write-all", _line_of("write-all")))


def unhashed_cache_key() -> Column:
    """Unlike the built-in cache rule, a step without a key is not flagged."""
    def flagged(s: Column) -> Column:
        key = F.try_element_at(s["step"]["with_params"], F.lit("key"))
        return F.coalesce(s["step"]["uses"].contains("actions/cache@") & ~key.contains("hashFiles("), F.lit(False))

    return F.transform(F.filter(steps_with_job(), flagged), lambda _: _hit("cicd-cache-no-hash", _line_of("actions/cache")))


STRUCTURAL = [
    title_in_run,
    issue_body_in_run,
    target_with_write_all,
    tag_pinned,
    branch_pinned,
    write_all_token,
    unhashed_cache_key,
]
