"""Hard-coded secrets: every match of every rule on every line of every scannable file.

No shuffle and no file x rule join.  One pass over the contents: a search for
literal hints tells which rules can match in a file at all and drops most
files, the joined pattern of those rules drops most lines inside the line
array, and only the remaining lines are exploded and matched rule by rule.  The
rule texts are joined last, to findings only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift.functions import text
from fleetsift.operators import ingest
from fleetsift.schemas import FINDINGS, conform
from fleetsift.sources.secret_rules import BUILT_IN, SecretRule

# Letters that fold to an ASCII letter when case is ignored but not by lower().
_FOLDED_LETTERS = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"}
_LEADING_FLAGS = re.compile(r"^\(\?([a-zA-Z]+)\)")
# Patterns that refer to their groups by number or name cannot be joined with others.
_GROUP_REFERENCE = re.compile(r"\\[1-9]|\\k<|\(\?<[A-Za-z]")


def _grouped(pattern: str) -> str:
    """The pattern as a group of its own, so its inline flags stay inside it."""
    flags = _LEADING_FLAGS.match(pattern)
    if flags:
        return f"(?{flags.group(1)}:{pattern[flags.end():]})"
    return f"(?:{pattern})"


def folded(content: Column) -> Column:
    """Lower case, with the odd letters a case-blind pattern takes for ASCII ones folded too."""
    plain = content
    for letter, ascii_letter in _FOLDED_LETTERS.items():
        plain = F.replace(plain, F.lit(letter), F.lit(ascii_letter))
    return F.lower(F.when(F.length(content) == F.octet_length(content), content).otherwise(plain))


def _joinable(rule: SecretRule) -> bool:
    return not _GROUP_REFERENCE.search(rule.pattern)


def pattern_for(content: Column, rules: Sequence[SecretRule]) -> Column:
    """The joined pattern of the rules whose hints the content holds; empty if no rule can match."""
    def applicable(low: Column) -> list[Column]:
        return [F.when(text.any_of([low.contains(hint) for hint in rule.hints]), _grouped(rule.pattern))
                if rule.hints else F.lit(_grouped(rule.pattern)) for rule in rules]

    joined = text.given(folded(content), lambda low: F.concat_ws("|", *applicable(low)))
    return text.given(joined, lambda p: F.when(p != "", F.concat(F.lit(text.regex("")), p)).otherwise(""))


def hit_lines_of(content: Column, rules: Sequence[SecretRule]) -> Column:
    """The lines some rule matches, as (line_number, line); NULL where no rule can match the file."""
    numbered = F.transform(text.lines(content), lambda line, i: F.struct((i + 1).alias("line_number"), line.alias("line")))
    joined = [rule for rule in rules if _joinable(rule)]
    alone = [text.regex(rule.pattern) for rule in rules if not _joinable(rule)]

    def matching(pattern: Column) -> Column:
        # regexp_instr keeps the compiled pattern from line to line; rlike would compile a computed one anew.
        def hit(n: Column) -> Column:
            return text.any_of([(pattern != "") & (F.regexp_instr(n["line"], pattern) > 0), *[n["line"].rlike(p) for p in alone]])

        return F.when((pattern != "") | F.lit(bool(alone)), F.filter(numbered, hit))

    return text.given(pattern_for(content, joined) if joined else F.lit(""), matching)


def match_secrets(files: DataFrame, rules: Sequence[SecretRule] = BUILT_IN) -> DataFrame:
    """(…, path, content) -> one row per (file, line, rule, match) with the redacted match."""
    if not rules:
        raise ValueError("no secret rules given")
    path, content = F.col("path"), F.col("content")
    scannable = files.filter(ingest.is_secret_scannable(path))
    hit_lines = scannable.select("repo_url", "scan_id", "path", F.explode(hit_lines_of(content, rules)).alias("hit"))
    per_rule = F.array(*[
        F.struct(
            F.lit(rule.id).alias("rule_id"),
            F.regexp_extract_all(F.col("hit.line"), F.lit(text.regex(rule.pattern)), F.lit(0)).alias("matches"))
        for rule in rules])
    matched = hit_lines.select("repo_url", "scan_id", "path", "hit.line_number", F.explode(per_rule).alias("rule"))
    return matched.select(
        "repo_url", "scan_id", "path", F.col("line_number").cast("bigint").alias("line_number"), "rule.rule_id",
        F.posexplode("rule.matches").alias("match_index", "match"),
    ).withColumn("redacted", F.concat(F.substring("match", 1, 4), F.lit("***"))).drop("match")


def secret_findings(files: DataFrame, rules: Sequence[SecretRule] = BUILT_IN) -> DataFrame:
    """Findings table rows.  The catalogue is a list the caller holds, so broadcasting it is bounded by that list."""
    spark = files.sparkSession
    texts = spark.createDataFrame(
        [(r.id, r.name, r.severity, r.description, r.cve_reference) for r in rules],
        "rule_id string, rule_name string, rule_severity string, description string, cve_reference string")
    found = match_secrets(files, rules).join(F.broadcast(texts), "rule_id")
    return conform(
        found.withColumnRenamed("path", "file_path").withColumns({
            "scanner_rank": F.lit(0),
            "item_index": F.col("match_index"),
            "finding_type": F.lit("secret"),
            "detail": F.col("redacted"),
            "confidence": F.when(ingest.is_high_risk_name(F.col("file_path")), "HIGH").otherwise("MEDIUM"),
        }), FINDINGS)
