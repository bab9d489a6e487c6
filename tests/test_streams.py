"""Streams against batch, batches run again, the whole audit."""

from pyspark.sql import functions as F

from fleetsift.operators import history, ingest
from fleetsift.operators.scoring import score_findings
from fleetsift.plans.audit import run_audit, scan_files
from fleetsift.schemas import SCORED_FINDINGS, conform
from fleetsift.sinks import tables
from fleetsift.streaming import continuous, logs, runs
from verification.inputs import Inputs

TOKEN = "AK" + "IA" + "Z" * 16
WORKFLOW = "on: push\npermissions: write-all\n"


def files_of(spark, rows):
    df = spark.createDataFrame(rows, "repo_url string, scan_id bigint, path string, content string")
    return ingest.ingest(df)


def test_stream_of_files_equals_batch_and_history_closes(spark, tmp_path):
    source, out = str(tmp_path / "in"), continuous.AuditTables(str(tmp_path / "out"))
    scans = spark.createDataFrame([(1, "r"), (2, "r")], "scan_id bigint, repo_url string").withColumn("scanned_at", F.lit("2024-05-01").cast("timestamp"))
    batches = [files_of(spark, [("r", 1, "a.py", TOKEN), ("r", 1, ".github/workflows/w.yml", WORKFLOW)]),
               files_of(spark, [("r", 2, "a.py", "clean"), ("r", 2, "b.py", TOKEN)]),
               files_of(spark, [("r", 2, ".github/workflows/w.yml", WORKFLOW)])]
    finished = [scans.filter("scan_id = 1"), scans.filter("scan_id = 1"), scans]
    for batch, done in zip(batches, finished):
        batch.write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        continuous.continuous_audit(stream, out, str(tmp_path / "checkpoint"), finished=lambda done=done: done)
    whole = score_findings(scan_files(batches[0].unionByName(batches[1]).unionByName(batches[2])))
    names = ["scan_id", "file_path", "rule_id", "line_number", "risk_score"]
    streamed = spark.read.parquet(out.findings)
    assert sorted(map(tuple, streamed.select(names).collect())) == sorted(map(tuple, whole.select(names).collect()))
    history = spark.read.parquet(out.history)
    assert sorted((r.scan_id, r.rule_id, r.file_path, r.status) for r in history.collect()) == [
        (1, "CICD-003", ".github/workflows/w.yml", "new"), (1, "SEC001", "a.py", "new"),
        (2, "CICD-003", ".github/workflows/w.yml", "persisting"), (2, "SEC001", "a.py", "fixed"), (2, "SEC001", "b.py", "new")]
    summaries = spark.read.parquet(out.scans)
    assert sorted((r.scan_id, r.total_count) for r in summaries.collect()) == [(1, 2), (2, 2)]
    # The last batch once more, as after a failure: nothing is doubled.
    continuous.close_scans(spark, out, scans, 2)
    assert spark.read.parquet(out.history).count() == 5 and spark.read.parquet(out.scans).count() == 2


def test_late_findings_change_their_scan_and_the_next(spark, tmp_path):
    source, out = str(tmp_path / "in"), continuous.AuditTables(str(tmp_path / "out"))
    scans = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r"), (9, "s")], "scan_id bigint, repo_url string").withColumn("scanned_at", F.lit("2024-05-01").cast("timestamp"))
    # Scan 3 is finished before scan 2; scan 1 gets a file when all are closed; then scan 3 does.
    batches = [([(1, "a.py"), (3, "a.py"), (9, "x.py")], "scan_id <> 2"), ([(2, "b.py")], "true"), ([(1, "b.py")], "true"), ([(3, "b.py")], "true")]
    reasons = []
    for k, (rows, done) in enumerate(batches):
        scored = conform(spark.createDataFrame(rows, "scan_id bigint, file_path string").withColumn("rule_id", F.lit("A")), SCORED_FINDINGS)
        scored.write.mode("append").parquet(source)
        continuous.continuous_history(spark.readStream.schema(scored.schema).parquet(source), out, str(tmp_path / "checkpoint"), lambda done=done: scans.filter(done))
        reasons.append({(r.scan_id, r.reason) for r in spark.read.parquet(out.closings).filter(F.col("batch") == k).collect()})
    assert reasons == [{(1, "finished"), (3, "finished"), (9, "finished")}, {(2, "finished"), (3, "follows")}, {(1, "late"), (2, "follows")}, {(3, "late")}]
    got = sorted((r.scan_id, r.file_path, r.status) for r in continuous.current_history(spark, out).collect())
    assert got == [(1, "a.py", "new"), (1, "b.py", "new"), (2, "a.py", "fixed"), (2, "b.py", "persisting"), (3, "a.py", "new"), (3, "b.py", "persisting"), (9, "x.py", "new")]
    assert sorted((r.scan_id, r.total_count) for r in continuous.current_scans(spark, out).collect()) == [(1, 2), (2, 1), (3, 2), (9, 1)]
    # A batch run again leaves the same tables.
    continuous.close_scans(spark, out, scans, 3)
    assert sorted((r.scan_id, r.file_path, r.status) for r in continuous.current_history(spark, out).collect()) == got
    # Directories of other scans are not read.
    wanted = spark.createDataFrame([(9,)], "scan_id bigint")
    rows = tables.read_scans(spark, out.findings, SCORED_FINDINGS, wanted)
    assert [r.file_path for r in rows.collect()] == ["x.py"]
    assert "PartitionFilters: [bucket" in rows._jdf.queryExecution().executedPlan().toString().replace("isnotnull(bucket", "bucket")


def test_statuses_of_whole_scans_take_one_shuffle(spark):
    """As by way of a table of statuses: null and repeated keys, rows that come twice, keys of scans without findings."""
    now = [(1, "A", "a"), (1, "A", "a"), (1, None, "b"), (1, "B", None), (2, "A", "a"), (3, "C", "c"), (3, None, None)]
    before = [(1, "A", "a"), (1, "A", "a"), (1, "", "b"), (1, "D", "d"), (1, "D", "d"), (3, "", ""), (4, "E", "e")]
    own = conform(spark.createDataFrame(now, "scan_id bigint, rule_id string, file_path string").withColumn("severity", F.lit("LOW")), SCORED_FINDINGS)
    earlier = spark.createDataFrame(before, "scan_id bigint, rule_id string, file_path string")
    got = history.rows_of_whole_scans(own, earlier).drop("bucket")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    wanted = history.rows_with_status(own, history.key_statuses(history.finding_keys(own), earlier))
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.select(got.columns).collect()))
    assert got.count() == 7 + 2


def test_scans_above_a_share_are_closed_alike(spark, tmp_path, monkeypatch):
    scans = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r"), (9, "s")], "scan_id bigint, repo_url string").withColumn("scanned_at", F.lit("2024-05-01").cast("timestamp"))
    rows = [(1, f"{k % 40}.py") for k in range(200)] + [(2, "1.py"), (2, "x.py"), (3, "x.py"), (9, "y.py"), (None, "z.py")]
    found = conform(spark.createDataFrame(rows, "scan_id bigint, file_path string").withColumn("rule_id", F.lit("A")), SCORED_FINDINGS)
    got = []
    for most in (10 ** 6, 10):
        monkeypatch.setattr(continuous, "TOGETHER", most)
        out = continuous.AuditTables(str(tmp_path / str(most)))
        tables.write_bucketed(found, out.findings, 0)
        continuous.close_scans(spark, out, scans, 0)
        roles = scans.select("scan_id")
        closing = spark.read.parquet(out.closings)
        assert sorted(continuous._heavy_scans(spark, out, 0, closing, roles)) == ([] if most > 10 else [1, 2])
        got.append(sorted((r.scan_id, r.file_path, r.status) for r in continuous.current_history(spark, out).collect()))
    assert got[0] == got[1] and len(got[0]) == 204 + 39 + 1
    assert [r for r in got[0] if r[0] in (3, 9)] == [(3, "1.py", "fixed"), (3, "x.py", "persisting"), (9, "y.py", "new")]


def test_lines_are_delivered_once_and_in_order(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "lines")
    schema = "scan_id bigint, ts timestamp, line_no bigint, line string"
    seen = []
    for start in (0, 5):
        rows = [(n % 2, None, n, "   " if n % 3 == 0 else f"line {n} \t") for n in reversed(range(start, start + 5))]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        runs.deliver_lines(logs.clean_lines(spark.readStream.schema(schema).parquet(source)), out, str(tmp_path / "checkpoint"))
        seen.append(spark.read.parquet(out).count())
    rows = spark.read.parquet(out).orderBy("batch", "scan_id", "line_no").collect()
    assert seen == [3, 6]
    assert sorted(r.line for r in rows) == [f"line {n}" for n in range(10) if n % 3]


def test_summary_takes_the_last_line_and_zeros(spark):
    lines = spark.createDataFrame(
        [(1, "2024-01-01", 1, "9 critical · 9 high · 9 medium · 9 low"), (1, "2024-01-01", 2, "Scan complete — 1 CRITICAL · 2 high · 3 medium · 4 low"),
         (1, "2024-01-02", 0, "done"), (2, "2024-01-01", 1, "nothing")], "scan_id bigint, ts string, line_no bigint, line string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = {r.scan_id: (r.log_count, r.critical, r.high, r.medium, r.low) for r in logs.log_stats(lines).collect()}
    assert rows == {1: (3, 1, 2, 3, 4), 2: (1, 0, 0, 0, 0)}


def test_line_classes(spark):
    texts = ["Phase 1 ok", "all OK", "Token", "WARN", "an error", "X Cannot", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("class", logs.line_class(F.col("line")))
    assert [r["class"] for r in df.collect()] == ["log-phase", "log-ok", "log-ok", "log-warn", "log-err", "log-err", ""]


def test_whole_audit_writes_all_tables(spark, tmp_path):
    out = str(tmp_path / "audit")
    files = files_of(spark, [("r", 1, "a.py", TOKEN), ("r", 1, "w.yml", WORKFLOW), ("s", 2, "x.py", "")])
    scans = spark.createDataFrame([(1, "r", None), (2, "s", None), (3, "t", "no access")], "scan_id bigint, repo_url string, error string").withColumn(
        "scanned_at", F.lit("2024-05-01").cast("timestamp"))
    gate = {r.scan_id: r.exit_code for r in run_audit(files, scans, out, 1, threshold="MEDIUM").collect()}
    assert gate == {1: 1, 2: 0, 3: 2}
    again = {r.scan_id: r.exit_code for r in run_audit(files, scans, out, 1, threshold="CRITICAL").collect()}
    assert again == {1: 0, 2: 0, 3: 2}
    assert spark.read.parquet(f"{out}/scans").count() == 2
    assert {r.status for r in spark.read.parquet(f"{out}/history").collect()} == {"new"}
    assert spark.read.text(f"{out}/sarif/batch=1").filter("value like '{%schema%'").count() == 2
    # The next scan of the same repository, without the secret.
    later = spark.createDataFrame([(4, "r", None)], "scan_id bigint, repo_url string, error string").withColumn("scanned_at", F.lit("2024-05-02").cast("timestamp"))
    run_audit(files_of(spark, [("r", 4, "w.yml", WORKFLOW)]), later, out, 2)
    assert sorted((r.rule_id, r.status) for r in spark.read.parquet(f"{out}/history").filter("scan_id = 4").collect()) == [("CICD-003", "persisting"), ("SEC001", "fixed")]


def test_batch_written_again_replaces_itself(spark, tmp_path):
    table = str(tmp_path / "t")
    for n in (3, 2):
        tables.write_batch(spark.range(n), table, 1)
    tables.write_batch(spark.range(4), table, 2)
    assert spark.read.parquet(table).groupBy("batch").count().orderBy("batch").collect()[0]["count"] == 2
    assert tables.read_or_empty(spark, str(tmp_path / "none"), "id bigint").count() == 0


def test_stream_of_a_table_that_is_a_directory_or_a_file(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "dir" / "documents.parquet"))
    docs.write.parquet(str(tmp_path / "dir" / "more_documents.parquet"))
    (tmp_path / "file").mkdir()
    docs.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    for kind in ("dir", "file"):
        inputs, out = Inputs(spark, str(tmp_path / kind)), str(tmp_path / f"{kind}_out")
        runs.drain(inputs.stream("b_files"), str(tmp_path / f"{kind}_checkpoint"), lambda batch, k, out=out: tables.write_batch(batch, out, k))
        got = [tuple(r) for r in spark.read.parquet(out).drop("batch").collect()]
        assert sorted(got) == sorted(tuple(r) for r in inputs.files.collect()) and len(got) == 6
