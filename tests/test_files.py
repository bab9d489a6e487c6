"""File selection, decoding and checkouts."""

import pytest
from fleetsift.operators import ingest
from fleetsift.sources import repo_files


@pytest.mark.parametrize("path, kept", [
    ("build", False), ("vendor/x.py", False), ("mybuild/x.py", True), ("a/X.YML", True), (".env", True), ("a/.env.local", True),
    ("img/logo.png", False), ("a/My.Dockerfile.txt", True), ("Jenkinsfile", True), (".circleci/config.yml", True), ("a/node_modules/p.js", False),
    ("README", False), ("foo.", False), ("sub/.git/config", False),
])
def test_kept(make_files, path, kept):
    assert (ingest.select_repo_files(make_files((path, ""))).count() == 1) is kept


@pytest.mark.parametrize("path, file_type", [
    (".env", ".env"), ("a/.env.local", ".local"), ("a/X.YML", ".yml"), ("Dockerfile", "Dockerfile"), ("a.b/c", "c"), ("x.tar.gz", ".gz")])
def test_file_type(make_files, path, file_type):
    assert ingest.classify_repo_files(make_files((path, ""))).first().file_type == file_type


def test_upper_case_yaml_is_kept_but_not_scanned_as_yaml(make_files):
    files = make_files(("X.YML", "a: 1"))
    assert ingest.select_repo_files(files).count() == 1
    assert ingest.yaml_files(files).count() == 0


@pytest.mark.parametrize("url, owner, name", [
    ("https://github.com/o/foo.github.io", "o", "foohub.io"), ("https://github.com/o/r.git/", "o", "r"),
    ("https://github.com/o/r//", "o", "r"), ("x", "unknown", "unknown"), ("", "unknown", "unknown"), ("a/b", "a", "b")])
def test_owner_and_name(spark, url, owner, name):
    row = ingest.with_owner_and_name(spark.createDataFrame([(url,)], "repo_url string")).first()
    assert (row.owner, row.repo_name) == (owner, name)


@pytest.mark.parametrize("raw, text", [
    (b"a\xff\xfeb\r\nc\rd", "ab\nc\nd"), (b"", ""), ("ok � kept".encode(), "ok � kept"), (b"\xf0\x9f", ""), ("é".encode() + b"\x80", "é")])
def test_decoding_equals_lenient_reading(spark, raw, text):
    row = repo_files.decode_files(spark.createDataFrame([(bytearray(raw),)], "raw binary")).first()
    assert row.content == text
    assert row.size_bytes == len(raw)


def test_checkouts_with_hidden_files(spark, tmp_path):
    for name, raw in [(".github/workflows/ci.yml", b"on: push"), (".env", b"A=1"), ("a/b.py", b"x\r\n"), ("node_modules/q.js", b""), ("x.png", b"")]:
        target = tmp_path / "repo" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(raw)
    checkouts = spark.createDataFrame([("https://github.com/o/r", 7, str(tmp_path / "repo"))], "repo_url string, scan_id bigint, root string")
    rows = {r.path: r for r in repo_files.read_checkouts(spark, checkouts).collect()}
    assert set(rows) == {".github/workflows/ci.yml", ".env", "a/b.py"}
    assert rows[".github/workflows/ci.yml"].is_workflow and rows[".env"].is_env_file
    assert rows["a/b.py"].content == "x\n" and rows["a/b.py"].size_bytes == 3


def test_requests(spark):
    asked = spark.createDataFrame([(1, "  https://github.com/o/r "), (2, "http://github.com/o/r"), (3, None)], "scan_id bigint, repo_url string")
    assert [r.repo_url for r in ingest.accepted_requests(asked).collect()] == ["https://github.com/o/r"]
    assert sorted(r.scan_id for r in ingest.rejected_requests(asked).collect()) == [2, 3]


def test_scanner_switched_off_before_it_runs(make_files, spark):
    requests = spark.createDataFrame([(1, True, False, None)], "scan_id bigint, skip_secrets boolean, skip_misconfigs boolean, skip_deps boolean")
    files = make_files(("a.py", ""))
    assert ingest.files_to_scan(files, requests, "secret").count() == 0
    assert ingest.files_to_scan(files, requests, "misconfig").count() == 1
    assert ingest.files_to_scan(files, requests, "dependency").count() == 1
    none = spark.createDataFrame([], requests.schema)
    assert ingest.files_to_scan(files, none, "secret").count() == 1


def test_filter_reaches_the_scan(spark, tmp_path, make_files):
    make_files(("a.yml", "x"), ("b.py", "y")).write.parquet(str(tmp_path / "files"))
    plan = ingest.yaml_files(spark.read.parquet(str(tmp_path / "files"))).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
