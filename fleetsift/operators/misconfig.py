"""Workflow misconfiguration rules.

Each rule is an expression that turns one parsed workflow row into an array of
hits; the driver concatenates the arrays and explodes once.  So all rules share
one pass over the parsed files, without shuffle, cache or re-parse, and a rule
that a file's odd types defeat yields an empty array for that file only.

A rule is any function `() -> Column` over the columns of `parse_workflows`
(and `line_of`, which looks a text up in the file) whose result is an array of `schemas.RULE_HIT`; callers pass their own list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift import fixed_values as V
from fleetsift.functions import text
from fleetsift.operators import workflows
from fleetsift.schemas import FINDINGS, RULE_HIT, conform

Rule = Callable[[], Column]

_HITS = f"array<struct<{RULE_HIT}>>"


def _content() -> Column:
    return F.col("content")


def line_of(needle: Column) -> Column:
    """First line of the file that contains the text."""
    return text.line_in(F.col("broken"), needle)


def _triggers() -> Column:
    return F.col("triggers")


def hit(rule_id: str, name: str | Column, line: Column, severity: str | Column, description: Column, *,
        detail: Column | str = "", reference: str | None = None, fix: Column | str = "",
        triggers: Column | None = None, source: str = "yaml_analysis") -> Column:
    def value(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        value(name).alias("rule_name"),
        line.alias("line_number"),
        value(severity).alias("rule_severity"),
        description.alias("description"),
        value(detail).alias("detail"),
        F.lit(source).alias("source"),
        F.lit(reference).cast("string").alias("cve_reference"),
        value(fix).alias("fix_suggestion"),
        (_triggers() if triggers is None else triggers).alias("affected_triggers"),
    )


def no_hits() -> Column:
    return F.array().cast(_HITS)


def hits_if(condition: Column, hits: Column) -> Column:
    return F.when(condition, hits).otherwise(no_hits())


def steps_with_job() -> Column:
    """All steps of the file as (job_name, step), in order."""
    return F.flatten(F.transform("jobs", lambda job: F.transform(
        job["steps"], lambda step: F.struct(job["job_name"].alias("job_name"), step.alias("step")))))


def _no_job(kinds: Sequence[str]) -> Column:
    return ~F.exists("jobs", lambda job: job["steps_kind"].isin(list(kinds)))


def _no_step(condition: Callable[[Column], Column]) -> Column:
    return ~F.exists("jobs", lambda job: F.exists(job["steps"], condition))


# A job whose steps are one of these stops rules that walk the steps as they come …
_UNWALKABLE = ["scalar", "empty_scalar", "null"]
# … and one of these stops rules that treat empty steps as none.
_UNWALKABLE_IF_SET = ["scalar"]


def _param(step: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(step["with_params"], F.lit(name)), F.lit(""))


def script_injection() -> Column:
    texts = V.WORKFLOW_RULE_TEXTS["CICD-001"]
    contexts = F.array(*[F.lit(c) for c in V.UNTRUSTED_CONTEXTS])
    pairs = F.flatten(F.transform(steps_with_job(), lambda s: F.transform(
        F.filter(contexts, lambda c: F.coalesce(F.contains(s["step"]["run"], c), F.lit(False))),
        lambda c: F.struct(s["job_name"].alias("job"), c.alias("context")))))
    hits = F.transform(pairs, lambda p: hit(
        "CICD-001", texts["name"], line_of(p["context"]), "CRITICAL",
        text.fill(texts["description"], context=p["context"], job=p["job"]),
        detail=text.fill(texts["detail"], context=p["context"]),
        reference=texts["reference"],
        fix=text.fill(texts["fix"], context=p["context"])))
    return hits_if(_no_job(_UNWALKABLE_IF_SET), hits)


def untrusted_checkout() -> Column:
    texts = V.WORKFLOW_RULE_TEXTS["CICD-002"]

    def is_checkout(step: Column) -> Column:
        return step["uses_text"].contains("actions/checkout")

    def reads_head(s: Column) -> Column:
        ref = _param(s["step"], "ref")
        return is_checkout(s["step"]) & (ref.contains("head") | ref.contains("pull_request"))

    hits = F.transform(F.filter(steps_with_job(), reads_head), lambda s: hit(
        "CICD-002", texts["name"], line_of(F.lit("pull_request_target")), "CRITICAL",
        text.fill(texts["description"], ref=_param(s["step"], "ref")),
        reference=texts["reference"], fix=texts["fix"]))
    return hits_if(
        F.array_contains(_triggers(), "pull_request_target") & _no_job(_UNWALKABLE_IF_SET)
        & _no_step(lambda step: is_checkout(step) & ~step["with_is_map"]),
        hits)


def _write_scopes(perms: Column) -> Column:
    return F.map_keys(F.map_filter(perms, lambda _, v: F.coalesce(v == "write", F.lit(False))))


def write_scope_count(perms: Column) -> Column:
    return F.coalesce(F.size(_write_scopes(perms)), F.lit(0))


def broad_permissions() -> Column:
    write_all, broad = V.WORKFLOW_RULE_TEXTS["CICD-003 write-all"], V.WORKFLOW_RULE_TEXTS["CICD-003 broad"]

    def level(label: Column, perms_str: Column, perms: Column, named: Column) -> Column:
        return F.struct(label.alias("level"), perms_str.alias("all"), _write_scopes(perms).alias("scopes"), named.alias("named"))

    levels = F.concat(
        F.array(level(F.lit("workflow level"), F.col("perms_str"), F.col("perms"), F.col("perms_named"))),
        F.transform("jobs", lambda job: level(
            F.concat(F.lit("job `"), job["job_name"], F.lit("`")), job["perms_str"], job["perms"], job["perms_named"])))

    def is_write_all(p: Column) -> Column:
        return F.coalesce(p["all"] == "write-all", F.lit(False))

    def is_broad(p: Column) -> Column:
        return F.coalesce(F.size(p["scopes"]) > V.BROAD_WRITE_SCOPES, F.lit(False))

    def to_hit(p: Column) -> Column:
        return (F.when(is_write_all(p), hit(
            "CICD-003", write_all["name"], line_of(F.lit("write-all")), "HIGH",
            text.fill(write_all["description"], level=p["level"]), fix=write_all["fix"]))
            .otherwise(hit(
                "CICD-003", broad["name"], line_of(F.lit("permissions")), "MEDIUM",
                text.fill(broad["description"], count=F.size(p["scopes"]).cast("string"), level=p["level"],
                          scopes=F.array_join(p["scopes"], ", ")),
                fix=broad["fix"])))

    hits = F.transform(F.filter(levels, lambda p: is_write_all(p) | is_broad(p)), to_hit)
    return hits_if(~F.exists(levels, lambda p: is_broad(p) & ~p["named"]), hits)


def unpinned_actions() -> Column:
    texts = V.WORKFLOW_RULE_TEXTS["CICD-004"]

    def split_uses(s: Column) -> Column:
        uses = s["step"]["uses"]
        ref = F.substring_index(uses, "@", -1)
        action = F.substring(uses, F.lit(1), F.length(uses) - F.length(ref) - 1)
        return F.struct(uses.alias("uses"), action.alias("action"), ref.alias("ref"))

    with_ref = F.filter(steps_with_job(), lambda s: F.coalesce(F.contains(s["step"]["uses"], F.lit("@")), F.lit(False)))
    mutable = F.filter(F.transform(with_ref, split_uses),
                       lambda u: ~u["ref"].rlike("(?di)" + V.COMMIT_SHA_PATTERN))
    hits = F.transform(mutable, lambda u: hit(
        "CICD-004", texts["name"], line_of(u["uses"]),
        F.when(u["ref"].isin(V.MUTABLE_BRANCHES), "HIGH").otherwise("MEDIUM"),
        text.fill(texts["description"], action=u["action"], ref=u["ref"]),
        detail=text.fill(texts["detail"], uses=u["uses"]),
        fix=text.fill(texts["fix"], action=u["action"], ref=u["ref"])))
    return hits_if(_no_job(_UNWALKABLE) & _no_step(lambda step: step["uses_breaks"]), hits)


def unhashed_cache() -> Column:
    texts = V.WORKFLOW_RULE_TEXTS["CICD-005"]

    def is_cache(step: Column) -> Column:
        return step["uses_text"].contains("actions/cache")

    found = F.filter(steps_with_job(),
                     lambda s: is_cache(s["step"]) & ~_param(s["step"], "key").contains("hashFiles"))
    hits = F.transform(found, lambda _: hit(
        "CICD-005", texts["name"], line_of(F.lit("actions/cache")), "HIGH",
        F.lit(texts["description"]), fix=texts["fix"]))
    return hits_if(
        _no_job(_UNWALKABLE) & _no_step(lambda step: is_cache(step) & ~step["with_is_map"]), hits)


def unsafe_commands() -> Column:
    texts = V.WORKFLOW_RULE_TEXTS["CICD-006"]
    return hits_if(
        _content().contains(V.UNSAFE_COMMANDS_SWITCH) & _content().contains("true"),
        F.array(hit("CICD-006", texts["name"], line_of(F.lit(V.UNSAFE_COMMANDS_SWITCH)), "HIGH",
                    F.lit(texts["description"]), fix=texts["fix"],
                    triggers=F.array().cast("array<string>"))))


_HARDCODED = text.regex(V.HARDCODED_VALUE_PATTERN)


def hardcoded_values() -> Column:
    texts = V.WORKFLOW_RULE_TEXTS["CICD-007"]
    matches = F.transform(
        F.regexp_extract_all(_content(), F.lit(_HARDCODED), F.lit(0)),
        lambda m: F.struct(
            m.alias("match"),
            F.regexp_extract(m, _HARDCODED, 1).alias("word"),
            F.regexp_extract(m, _HARDCODED, 2).alias("value")))
    literal = F.filter(matches, lambda m: ~m["value"].contains("${{"))
    return F.transform(literal, lambda m: hit(
        "CICD-007", texts["name"],
        line_of(F.substring(m["match"], 1, V.HARDCODED_VALUE_PREFIX)), "HIGH",
        text.fill(texts["description"], word=m["word"]), fix=texts["fix"]))


RULES: list[Rule] = [
    script_injection,
    untrusted_checkout,
    broad_permissions,
    unpinned_actions,
    unhashed_cache,
    unsafe_commands,
    hardcoded_values,
]


def apply_rules(parsed: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Parsed workflows -> findings of the given rules, in rule order within each file."""
    hits = F.concat(*[rule().cast(_HITS) for rule in rules])
    located = parsed.withColumn("broken", text.newline_breaks(_content()))
    found = located.select("repo_url", "scan_id", F.col("path").alias("file_path"), F.posexplode(hits).alias("item_index", "hit"))
    return conform(found.select("*", "hit.*").withColumns(
        {"scanner_rank": F.lit(1), "finding_type": F.lit("misconfig")}), FINDINGS)


def may_be_flagged(content: Column) -> Column:
    """False only if no built-in or structural rule can fire, whatever the file parses to.

    Keys and values stand in the text as they are unless escaped, so a file
    without any of these words and without a backslash needs no parsing.
    """
    words = ("uses", "permissions", "github.", V.UNSAFE_COMMANDS_SWITCH, "\\")
    return text.holds(content, lambda c: text.any_of([c.contains(w) for w in words]) | c.rlike(_HARDCODED))


def misconfig_findings(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Files -> findings.  Files no built-in rule can flag are dropped before parsing."""
    from fleetsift.operators.structural import STRUCTURAL

    known = {*RULES, *STRUCTURAL}
    wanted = files.filter(may_be_flagged(F.col("content"))) if all(r in known for r in rules) else files
    return apply_rules(workflows.parse_workflows(wanted), rules)
