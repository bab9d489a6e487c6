"""Statuses, previous scans, summaries; hot keys; partition invariance."""

import random

import pytest
from pyspark.sql import functions as F

from fleetsift.functions import spread
from fleetsift.operators import history, report, scoring
from fleetsift.schemas import FINDINGS, conform
from fleetsift.sinks import sarif


def scans_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "scan_id bigint, repo_url string").withColumn("scanned_at", F.lit("2024-01-01").cast("timestamp"))


def findings_of(spark, *rows):
    return conform(spark.createDataFrame(list(rows), "scan_id bigint, rule_id string, file_path string, line_number bigint")
                   .withColumns({"finding_type": F.lit("secret"), "rule_severity": F.lit("HIGH"), "item_index": F.col("line_number")}), FINDINGS)


def statuses(rows):
    return sorted((r.scan_id, r.rule_id, r.file_path, r.status) for r in rows.collect())


def test_new_fixed_new(spark):
    scans = scans_of(spark, (1, "r"), (2, "r"), (3, "r"), (4, "other"))
    findings = scoring.score_findings(findings_of(spark, (1, "A", "f", 1), (3, "A", "f", 9), (3, "A", "f", 10), (4, "A", "f", 1)))
    assert statuses(history.history_rows(findings, scans)) == [
        (1, "A", "f", "new"), (2, "A", "f", "fixed"), (3, "A", "f", "new"), (3, "A", "f", "new"), (4, "A", "f", "new")]


def test_lines_do_not_matter_for_persisting(spark):
    scans = scans_of(spark, (1, "r"), (2, "r"))
    findings = scoring.score_findings(findings_of(spark, (1, "A", "f", 1), (2, "A", "f", 5), (2, "A", "f", 6)))
    assert [s[3] for s in statuses(history.history_rows(findings, scans))] == ["new", "persisting", "persisting"]


def test_one_scan_at_a_time_gives_the_same_history(spark):
    rng = random.Random(7)
    ids = list(range(1, 9))
    scans = scans_of(spark, *[(i, f"r{i % 2}") for i in ids])
    findings = scoring.score_findings(findings_of(spark, *{(i, f"R{rng.randrange(3)}", f"f{rng.randrange(3)}", rng.randrange(2)) for i in ids for _ in range(4)}))
    whole = statuses(history.history_rows(findings, scans))
    stored, stored_scans = None, None
    for i in ids:
        one, its = scans.filter(F.col("scan_id") == i), findings.filter(F.col("scan_id") == i)
        empty = history.history_rows(findings, scans).limit(0)
        rows = history.history_rows_for_new_scans(its, one, stored or empty, stored_scans or scans.limit(0))
        collected = spark.createDataFrame(rows.collect(), rows.schema)
        stored = collected if stored is None else stored.unionByName(collected)
        stored_scans = one if stored_scans is None else stored_scans.unionByName(one)
    assert statuses(stored) == whole
    assert {"new", "persisting", "fixed"} <= {s[3] for s in whole}


@pytest.mark.parametrize("ranges, widest", [(1, 2000), (3, 2000), (64, 2000), (64, 1 << 62), (200, 1 << 62)])
def test_previous_scan_in_any_range(spark, ranges, widest):
    rng = random.Random(3)
    # One repository has most scans.
    rows = [(i, "hot" if rng.random() < 0.7 else f"r{rng.randrange(4)}") for i in rng.sample(range(1, widest), 300)]
    last, expected = {}, set()
    for scan_id, repo in sorted(rows):
        expected.add((repo, scan_id, last.get(repo)))
        last[repo] = scan_id
    got = {(r.repo_url, r.scan_id, r.prev_scan_id) for r in history.previous_scans(scans_of(spark, *rows), ranges).collect()}
    assert got == expected


def test_no_window_over_a_whole_repository_or_scan(spark):
    scans = scans_of(spark, (1, "r"))
    findings = scoring.score_findings(findings_of(spark, (1, "A", "f", 1)))
    plan = history.history_rows(findings, scans)._jdf.queryExecution().optimizedPlan().toString()
    assert all("id_range" in line for line in plan.splitlines() if "Window [" in line)
    top = report.top_findings(findings)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top and "Partial" in top


@pytest.mark.parametrize("share", [0.0, 0.9])
def test_a_heavy_key_is_joined_in_pieces(spark, share):
    tasks, n = 16, 40_000
    rows = spark.range(n).select(F.when(F.col("id") < share * n, 0).otherwise(F.col("id") % 3_000).alias("k"), F.col("id").alias("v"))
    lookup = spark.range(3_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spread.join_spread(rows, lookup, ["k"])
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("task")).count().collect())
        assert joined.columns == ["k", "v", "w"] and joined.count() == n and joined.filter("w <> 2 * k").count() == 0
        assert sizes[-1] < 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_heavy_keys_of_nothing(spark):
    none = spark.range(0).selectExpr("id k")
    assert spread.heavy_keys(none, ["k"], 8) == {} and spread.quantile_boundaries(none, "k") == []


def test_places_in_groups_counted_in_ranges(spark, tmp_path):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.9 else f"g{rng.randrange(5)}", rng.randrange(50), k) for k in range(3_000)]
    df = spark.createDataFrame(rows, "g string, a int, b int")
    want = {}
    for g, a, b in sorted(rows):
        want[g, a, b] = sum(1 for k in want if k[0] == g) + 1
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = spread.numbered(df, ["g"], ["a", "b"], "place", str(tmp_path / "n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(r.g, r.a, r.b): r.place for r in got} == want


def test_places_in_ordinary_groups_take_no_second_pass(spark, tmp_path):
    rows = [(k % 40, k % 7, k) for k in range(800)] + [(None, 1, -1)]
    df = spark.createDataFrame(rows, "g int, a int, b int")
    got = spread.numbered(df, ["g"], ["a", "b"], "place", str(tmp_path / "n"), tasks=8).collect()
    want = {}
    for g, a, b in sorted(rows[:-1]):
        want[g, a, b] = sum(1 for k in want if k[0] == g) + 1
    assert {(r.g, r.a, r.b): r.place for r in got} == want and len(got) == 800
    assert not (tmp_path / "n").exists()


def test_one_document_for_a_scan_with_most_results(spark, tmp_path):
    import json
    rows = [(1, f"R{n % 7}", "a\\b", n) for n in range(26_000)] + [(2, "R1", 'q"uote', 3)]
    scored = scoring.score_findings(findings_of(spark, *rows))
    scans = scans_of(spark, (1, "r"), (2, "s"), (3, "none"))
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        sarif.write_documents(sarif.document_lines(scored, scans), str(tmp_path / "sarif"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    text = "".join(path.read_text() for path in sorted((tmp_path / "sarif" / "scan_range=0").glob("part-*")))
    found, at = [], 0
    while at < len(text.rstrip()):
        document, at = json.JSONDecoder().raw_decode(text, at)
        at += 1
        found.append(document["runs"][0])
    assert [(d["properties"]["repoUrl"], len(d["results"]), d["properties"]["totalFindings"]) for d in found] == [("r", 26_000, 26_000), ("s", 1, 1), ("none", 0, 0)]
    assert [r["id"] for r in found[0]["tool"]["driver"]["rules"]] == [f"R{k}" for k in range(7)]
    assert [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in found[0]["results"]] == [1, *range(1, 26_000)]


def test_hot_key_and_partition_invariance(spark):
    rng = random.Random(5)
    rows = [(1, "HOT", "f", n) for n in range(600)] + [(rng.randrange(1, 6), f"R{rng.randrange(9)}", f"f{rng.randrange(5)}", n) for n in range(1200)]
    scans = scans_of(spark, *[(i, f"r{i % 2}") for i in range(1, 7)])

    def results():
        scored = scoring.score_findings(findings_of(spark, *rows))
        return (statuses(history.history_rows(scored, scans)),
                sorted(map(tuple, report.severity_counts(scored).collect())),
                sorted((r.scan_id, r.rule_id, r.short_description, r.level) for r in report.rule_definitions(scored).collect()),
                sorted((r.scan_id, r.position, r.rule_id, r.line_number, r.more) for r in report.top_findings(scored).collect()),
                sorted((r.scan_id, r.part, r.document) for r in sarif.documents(scored, scans, results_per_document=100).collect()))

    first = results()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert results() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_top_findings_beyond_the_limit_spark_cuts_early(spark):
    scored = scoring.score_findings(findings_of(spark, *[(n % 2, f"R{n % 7}", f"f{n % 3}", n) for n in range(3000)]))
    whole = sorted((r.scan_id, r.position, r.line_number) for r in report.top_findings(scored, 1200).collect())
    assert len(whole) == 2400
    assert [r for r in whole if r[1] <= 50] == sorted((r.scan_id, r.position, r.line_number) for r in report.top_findings(scored, 50).collect())


def test_empty_scan_passes(spark):
    scans = scans_of(spark, (1, "r"), (2, "r")).withColumn("error", F.when(F.col("scan_id") == 2, "no access"))
    none = scoring.score_findings(findings_of(spark, (1, "A", "f", 1)).limit(0))
    assert sorted(map(tuple, report.gate(scans, none).collect())) == [(1, False, 0), (2, False, 2)]
    assert {r.verdict for r in report.verdicts(scans, none).collect()} == {"PASS"}
    assert [r.total_count for r in history.scan_summaries(scans, none).collect()] == [0, 0]
    assert sarif.documents(none, scans).count() == 2


@pytest.mark.parametrize("threshold, failed", [("CRITICAL", False), ("HIGH", False), ("medium", True), ("LOW", True), ("odd", False)])
def test_gate_thresholds(spark, threshold, failed):
    scans = scans_of(spark, (1, "r")).withColumn("error", F.lit(None).cast("string"))
    scored = scoring.score_findings(findings_of(spark, (1, "A", "f", 1)))
    assert report.gate(scans, scored, threshold).first().failed is failed


def test_sarif_documents_take_one_shuffle(spark, monkeypatch):
    """Findings travel once; the lines of a scan come out together, so putting them together moves nothing."""
    monkeypatch.setattr(spread, "LEAST_ROWS", 10)
    scored = scoring.score_findings(findings_of(spark, *[(k % 50, f"R{k % 3}", "a.py", k) for k in range(400)], (None, "R", "a.py", 1), (99, "R", "a.py", 1)))
    scans = scans_of(spark, *[(k, "r") for k in range(52)], (7, "s"), (None, "t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("section", "line_no", "line"))), lambda x: x["line"])
    lines = sarif.document_lines(scored, scans).groupBy("scan_id").agg(F.array_join(parts, "").alias("document"))
    documents = sarif.documents(scored, scans)
    for df in (lines, documents):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    joined = {r.scan_id: r.document for r in lines.collect()}
    assert set(joined) == {*range(52), 99, None} and '"results":[]' in joined[50] and '"totalFindings":8' in joined[3]
    rows = [(r.scan_id, r.document) for r in documents.collect()]
    assert len(rows) == 54 and sorted(k for k, _ in rows if k is not None) == sorted([*range(52), 7])
    assert all(text == joined[k] for k, text in rows if k != 7)
    # A scan that comes twice: a document for each row.
    assert sorted((text.count('"ruleId"'), text.count('"totalFindings":8')) for k, text in rows if k == 7) == [(16, 1), (16, 1)]


def test_sarif_parts_hold_every_result_once_with_its_rule(spark):
    import json
    scored = scoring.score_findings(findings_of(spark, *[(1, f"R{n % 7}", "a\\b", n) for n in range(500)]))
    docs = sarif.documents(scored, scans_of(spark, (1, "r")), results_per_document=60).collect()
    lines, seen = [], set()
    for d in docs:
        run = json.loads(d.document)["runs"][0]
        assert len(run["results"]) <= 60
        rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
        assert len(set(rules)) == len(rules) and {r["ruleId"] for r in run["results"]} == set(rules)
        assert run["properties"]["totalFindings"] == 500
        lines += [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"]]
        seen |= {r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in run["results"]}
    assert sorted(lines) == sorted(max(n, 1) for n in range(500)) and seen == {"a/b"}
    assert sorted(d.part for d in docs) == list(range(docs[0].parts))
