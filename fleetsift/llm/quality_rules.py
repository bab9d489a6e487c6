"""Quality rules learned as decision lists, with DataFrame operations only.

Every text is measured in one projection (words, symbols, repeated lines and word windows).  Rules are
found by sequential covering on labelled measurements: a conjunction of threshold conditions grows by
the condition with the largest information gain, is pruned on labels kept apart, and takes the rows it
covers out; what is left goes to the next rule.  The list becomes one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift.llm.common import uniform, words, written

#: Labelled texts that rules are learned from, and thresholds tried for each measure.
SAMPLE_ROWS, THRESHOLDS = 6_000, 24
WINDOW = 5
#: Characters that count as symbols, and capitals (fixed values).
SYMBOLS = r"[#*$%&|<>]+"
CAPITALS = "[A-ZÀ-ÖØ-Þ]+"


#: What a text is measured by.
MEASURED = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words"]


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of `docs` as one struct `row`, whatever their names, and beside it MEASURED and base_failed."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    out = docs.select(row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_words", words("_text"))
    out = out.withColumn("n_words", F.size("_words").cast("bigint"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    out = out.withColumn("_lines", lines).withColumn("_hashes", hashes)
    window = F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]))
    out = out.withColumn("_windows", F.when(F.size("_hashes") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_twice", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    placed = F.when(F.col("_twice"), F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    out = out.withColumn("_sorted", placed)
    equal = F.filter("_sorted", lambda e, k: F.coalesce(F.get("_sorted", k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["x"] == e["x"], F.lit(False)))
    out = out.withColumn("_starts", F.sort_array(F.transform(equal, lambda e: e["i"])))
    covered = F.transform("_starts", lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - v, F.lit(WINDOW))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("bigint"))
    out = (out.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
           .withColumn("n_symbols", (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("bigint"))
           .withColumn("n_capitals", (F.length("_text") - F.length(F.regexp_replace("_text", CAPITALS, ""))).cast("bigint"))
           .withColumn("n_lines", F.size("_lines").cast("bigint"))
           .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # One row each, through a generator: filters on the results then stay above it.  Pushed below, they would
    # put whole projections into the functions of others and measure a text anew for each of its words.
    return out.select("row", F.inline(F.array(F.struct(*[F.col(c) for c in MEASURED], failed.alias("base_failed")))))


def _opened(out: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    return out.select("row.*", *added).toDF(*docs.columns, *added)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words and base_failed, behind the columns of `docs`.

    Null and wordless texts measure 0 everywhere and fail the base rule.  Windows of five words are
    told apart by a 64-bit hash.
    """
    return _opened(_measured(docs, text_col), docs, *MEASURED, "base_failed")


def measures() -> dict[str, Column]:
    """What conditions are about."""
    n_words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {"n_words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / n_words, "symbols_per_word": F.col("n_symbols") / n_words,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / n_words,
            "capital_share": F.col("n_capitals") / chars, "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1))}


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.measure] > self.threshold if self.above else row[self.measure] <= self.threshold

    def column(self) -> Column:
        value = measures()[self.measure]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _counts(rows: list[dict], rule: Rule) -> tuple[int, int]:
    """Rejected and accepted labels a rule covers."""
    bad = good = 0
    for row in rows:
        if all(c.holds(row) for c in rule):
            bad, good = bad + row["bad"] * row["times"], good + (1 - row["bad"]) * row["times"]
    return bad, good


def learn(rows: list[dict], cuts: dict[str, list[float]], most_rules: int = 12, precision: float = 0.95, least_cover: int = 5) -> list[Rule]:
    """Rules for rejected rows, in order, from a summary of labelled rows (measures …, bad, fold, times).

    A third of the labels (fold 0) prunes; a rule stays if it is right for `precision` of what it
    covers there and it covers `least_cover` rejected labels in all.
    """
    rules: list[Rule] = []
    grow, prune = [r for r in rows if r["fold"]], [r for r in rows if not r["fold"]]
    tried = [Condition(m, above, t) for m, ts in cuts.items() for t in ts for above in (True, False)]
    while len(rules) < most_rules:
        rule: Rule = ()
        bad, good = _counts(grow, ())
        inside = grow
        while good and bad and len(rule) < 4:
            best = None
            for c in tried:
                b, g = _counts(inside, (c,))
                if b:
                    gain = b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good)))
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, c, b, g
            if best is None or best[0] <= 1e-9:
                break
            _, c, bad, good = best
            rule, inside = (*rule, c), [r for r in inside if c.holds(r)]
        if not rule:
            break
        worth = lambda r: (lambda b, g: (b - g) / (b + g) if b + g else -1.0)(*_counts(prune, r))
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        (b, g), (pb, pg) = _counts(grow, rule), _counts(prune, rule)
        if b + pb < least_cover or b < precision * (b + g) or pb < precision * (pb + pg):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r) for c in rule)] for part in (grow, prune))
    return rules


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules from at most `sample_rows` labelled texts (labels: doc_id, quality 0 or 1), drawn by a hash of their ids.

    Texts that fail the base rule teach nothing.  What reaches the driver is a summary: measures
    rounded to the thresholds below them, which decide every condition, with counts.
    """
    drawn = (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("_id"))
             .agg(F.min("quality").alias("_quality")).orderBy(uniform("rules", "_id"), "_id").limit(sample_rows))
    # The drawn labels are at most sample_rows pairs of numbers.
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_own")).join(F.broadcast(drawn), "_id")
    seen = written(measured(texts, "_own").where("not base_failed").select(
        *[c.alias(m) for m, c in measures().items()], (F.col("_quality") == 0).cast("int").alias("bad"),
        (uniform("fold", "_id") >= 1 / 3).cast("int").alias("fold")), "labelled")
    names = list(measures())
    points = [k / THRESHOLDS for k in range(1, THRESHOLDS)]
    quantiles = seen.agg(*[F.percentile_approx(m, points, 10_000).alias(m) for m in names]).first()
    if quantiles[0] is None:
        return []
    cuts = {m: sorted(set(quantiles[m])) for m in names}
    rounded = [F.greatest(F.lit(-math.inf), *[F.when(F.col(m) > F.lit(t), F.lit(math.nextafter(t, math.inf))) for t in cuts[m]]).alias(m) for m in names]
    summary = seen.select(*rounded, "bad", "fold").groupBy(*names, "bad", "fold").agg(F.count("*").alias("times"))
    return learn([r.asDict() for r in summary.collect()], cuts)


def verdict(rules: list[Rule]) -> Column:
    """The first rule that rejects a measured text, as words; null if none does."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        chain = chain.when(test, F.lit(" and ".join(map(str, rule))))
    return chain


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Adds the measures, `rule` (the rule that rejects the text) and `kept`: neither the base rule nor a learned one rejects it.

    One row per row of `docs`; null ids, repeated rows and empty tables are as any other.  What is
    added stands behind the columns of `docs`, which stay as they are, also those of the same names.
    """
    out = _measured(docs, text_col).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return _opened(out, docs, *MEASURED, "base_failed", "rule", "kept")
