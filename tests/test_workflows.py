"""Workflow parsing and rules: golden cases, odd types, line numbers."""

import pytest
import yaml

from fleetsift.operators import misconfig, scoring, structural, workflows

HEAD = "on: pull_request\njobs:\n  a:\n    steps:\n"


def flagged(make_files, content, rules=None, path="w.yml"):
    rows = misconfig.misconfig_findings(make_files((path, content)), rules or misconfig.RULES).collect()
    return sorted(rows, key=lambda r: r.item_index)


def ids(rows):
    return [r.rule_id for r in rows]


def test_write_permission_of_id_token_reads_as_hardcoded(make_files):
    rows = flagged(make_files, "permissions:\n  id-token: write\n")
    assert ids(rows) == ["CICD-007"] and rows[0].line_number == 2


def test_secret_reference_is_not_hardcoded(make_files):
    assert flagged(make_files, "env:\n  token: ${{ secrets.X }}\n  secret: abcde ${{ x }}\n") == []


def test_checkout_of_main_under_target_trigger(make_files):
    content = "on: [pull_request_target]\njobs:\n a:\n  steps:\n   - uses: actions/checkout@1234567\n     with: {ref: refs/heads/main}\n"
    rows = flagged(make_files, content)
    assert ids(rows) == ["CICD-002"] and "ref=`refs/heads/main`" in rows[0].description and rows[0].line_number == 1


@pytest.mark.parametrize("uses, severity", [
    ("a/b@1234567", None), ("a/b@ABCDEF0", None), ("./local", None), ("a/b@123456", "MEDIUM"), ("a/b@" + "0" * 41, "MEDIUM"),
    ("a/b@main", "HIGH"), ("a/b@latest", "HIGH"), ("a/b@HEAD", "MEDIUM"), ("a@b@v1", "MEDIUM"), ("a/b@", "MEDIUM")])
def test_pinning(make_files, uses, severity):
    rows = flagged(make_files, HEAD + f"      - uses: '{uses}'\n")
    assert [r.rule_severity for r in rows if r.rule_id == "CICD-004"] == ([severity] if severity else [])


def test_last_at_sign_splits(make_files):
    row = flagged(make_files, HEAD + "      - uses: 'a@b@v1'\n")[0]
    assert row.description.startswith("Action `a@b` pinned to `v1`") and row.detail == "uses: a@b@v1"


@pytest.mark.parametrize("scopes, count", [(3, 0), (4, 1)])
def test_write_scopes(make_files, scopes, count):
    content = "permissions:\n" + "".join(f"  s{i}: write\n" for i in range(scopes)) + "  r: read\n"
    rows = flagged(make_files, content)
    assert ids(rows) == ["CICD-003"] * count
    if count:
        assert rows[0].rule_severity == "MEDIUM" and "4 scopes in workflow level: s0, s1, s2, s3." in rows[0].description


@pytest.mark.parametrize("on, triggers", [
    ("on: push", ["push"]), ("'on': push", ["push"]), ("on: [push, 5]", ["push", "5"]), ("on:\n  push:\n  schedule:\n", ["push", "schedule"]),
    ("on:", []), ("on: 5", []), ("a: b", [])])
def test_triggers(on, triggers):
    assert workflows.parse_workflow(on)["triggers"] == triggers


@pytest.mark.parametrize("content, kept", [
    ("", True), ("# only a comment", True), ("[]", True), ("text", False), ("- a", False), ("a: [1", False), ("a: 1\n---\nb: 2", False),
    ("a: &x [1]\nb: *x", True), ("a: 2024-13-45", False), ("[" * 5000, False), ("- " * 5000 + "x", False), ("? [a]\n: b", False), ("a: !!python/object:os.x {}", False)])
def test_what_counts_as_a_workflow(content, kept):
    assert (workflows.parse_workflow(content) is not None) is kept


def test_content_rules_run_on_an_empty_document(make_files):
    rows = flagged(make_files, "# ACTIONS_ALLOW_UNSECURE_COMMANDS: true\n# token: abcdefgh\n")
    assert ids(rows) == ["CICD-006", "CICD-007"] and [r.line_number for r in rows] == [1, 2]


def test_scores_of_workflow_findings(make_files):
    def scores(content):
        return [(r.rule_id, r.risk_score, r.severity) for r in scoring.score_findings(
            misconfig.misconfig_findings(make_files(("w.yml", content)))).collect()]

    injection = "jobs: {a: {steps: [{run: 'echo ${{ github.head_ref }}'}]}}\n"
    assert scores("on: pull_request\n" + injection) == [("CICD-001", 8.5, "HIGH")]
    assert scores("on: [push, Pull_Request, schedule, release]\n" + injection) == [("CICD-001", 10.0, "CRITICAL")]
    assert scores("on: [pull_request]\n# ACTIONS_ALLOW_UNSECURE_COMMANDS true\n") == [("CICD-006", 5.0, "MEDIUM")]


@pytest.mark.parametrize("step, dropped", [
    ("uses: 5", {"CICD-004"}), ("uses: true", {"CICD-004"}), ("uses: [a]", set()), ("uses: ['@']", {"CICD-004"}), ("uses: {}", set()), ("uses: 0", set()),
])
def test_odd_uses_stops_one_rule_for_the_file(make_files, step, dropped):
    content = HEAD + f"      - {step}\n      - uses: a/b@v1\n      - run: ${{{{ github.head_ref }}}}\n"
    assert set(ids(flagged(make_files, content))) == {"CICD-001", "CICD-004"} - dropped


@pytest.mark.parametrize("steps, dropped", [
    ("null", {"CICD-004", "CICD-005"}), ("0", {"CICD-004", "CICD-005"}), ("5", {"CICD-001", "CICD-002", "CICD-004", "CICD-005"}), ("text", set()), ("{a: b}", set()), ("[]", set())])
def test_odd_steps(make_files, steps, dropped):
    content = ("on: [pull_request_target]\njobs:\n  odd:\n    steps: " + steps + "\n  a:\n    steps:\n"
               "      - {uses: actions/checkout@v1, with: {ref: head}}\n      - {uses: actions/cache@v1}\n      - {run: '${{ github.head_ref }}'}\n")
    assert set(ids(flagged(make_files, content))) == {"CICD-001", "CICD-002", "CICD-004", "CICD-005"} - dropped


@pytest.mark.parametrize("uses, gone", [("actions/checkout@v1", "CICD-002"), ("actions/cache@v1", "CICD-005")])
def test_odd_with_stops_only_the_rule_that_reads_it(make_files, uses, gone):
    content = ("on: [pull_request_target]\njobs:\n  a:\n    steps:\n      - {uses: " + uses + ", with: text}\n"
               "      - {uses: actions/checkout@v1, with: {ref: head}}\n      - {uses: actions/cache@v1}\n")
    assert set(ids(flagged(make_files, content))) == {"CICD-002", "CICD-004", "CICD-005"} - {gone}


def test_odd_permission_names_stop_the_permission_rule(make_files):
    names = "permissions: {1: write, b: write, c: write, d: write}\njobs: {a: {permissions: write-all}}\n"
    assert flagged(make_files, names) == []
    assert ids(flagged(make_files, names.replace("d: write", "d: read"))) == ["CICD-003"]


def test_cache_without_with_is_flagged_by_one_rule_only(make_files):
    content = HEAD + "      - uses: actions/cache@v1\n"
    assert "CICD-005" in ids(flagged(make_files, content))
    assert flagged(make_files, content, [structural.unhashed_cache_key]) == []


def test_values_are_read_as_text(make_files):
    content = "on: [pull_request_target]\njobs: {a: {steps: [{uses: actions/checkout@1234567, with: {ref: {head: 1}}}, {uses: actions/cache@1234567, with: {key: null}}]}}\n"
    rows = flagged(make_files, content)
    assert ids(rows) == ["CICD-002", "CICD-005"] and "ref=`{'head': 1}`" in rows[0].description


def test_escaped_keys_are_not_lost_to_the_gate(make_files):
    assert ids(flagged(make_files, '"\\x70ermissions": "write\\x2dall"\n')) == ["CICD-003"]


def test_structural_rules(make_files):
    content = ("on: [pull_request_target]\npermissions: write-all\njobs:\n  a:\n    permissions: write-all\n    steps:\n"
               "      - uses: a/b@v1.2\n      - uses: a/b@HEAD\n      - uses: a/b@v1 # note\n"
               "      - {run: 'x ${{github.event.issue.body}}'}\n      - run: github.event.pull_request.title\n"
               "      - {uses: actions/cache@v1, with: {key: k}}\n")
    rows = flagged(make_files, content, structural.STRUCTURAL)
    assert [(r.rule_id.removeprefix("SG-cicd-"), r.line_number) for r in rows] == [
        ("script-injection-issue-body", 10), ("prt-write-all", 1), ("unpinned-action-tag", 7), ("unpinned-action-branch", 8),
        ("token-write-all", 2), ("token-write-all", 2), ("cache-no-hash", 12)]
    assert {r.risk_score for r in scoring.score_findings(misconfig.misconfig_findings(make_files(("w.yml", content)), structural.STRUCTURAL)).collect()} == {4.0}


def test_lines_under_all_breaks(make_files):
    rows = flagged(make_files, "a: 1\r\nb: 2\x85c: 3\u2028permissions: write-all\n")
    assert [r.line_number for r in rows] == [4]


def test_needle_over_two_lines_counts_as_line_one(make_files):
    rows = flagged(make_files, "x: 1\ny: 2\ntoken:\n  abcdefgh\n")
    assert [(r.rule_id, r.line_number) for r in rows] == [("CICD-007", 1)]


def test_surrogates_do_not_break_the_table(make_files):
    rows = flagged(make_files, 'on: ["a\\ud800b"]\npermissions: write-all\n')
    assert [r.affected_triggers for r in rows] == [["ab"]]


def test_one_parse_for_all_rules(make_files):
    plan = misconfig.misconfig_findings(make_files(("w.yml", "a: 1")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("times", [1, 500, 501, 3000])
def test_verdict_does_not_depend_on_size(times):
    expressions = "".join(f"      - run: echo ${{{{ {k} }}}}\n" for k in range(times))
    body = f"permissions: write-all\njobs:\n  a:\n    steps:\n{expressions}"
    assert workflows.parse_workflow("on: push\n" + body) is not None
    assert workflows.parse_workflow("on:\tpush\n" + body) is None  # a tab cannot part a key from its value


def test_aliases_do_not_grow_the_text():
    levels = "".join(f"l{k}: &l{k} [{', '.join([f'*l{k - 1}'] * 10)}]\n" for k in range(1, 14))
    bomb = "l0: &l0 [a, main]\n" + levels + "on: push\njobs:\n  a:\n    steps:\n      - uses: *l13\n        with: {path: *l13, key: [x, {y: 1}, null]}\n"
    step = workflows.parse_workflow(bomb)["jobs"][0]["steps"][0]
    params = dict(step["with_params"])
    assert len(params["path"]) < 2000 and "main" in params["path"] and len(step["uses_text"]) < 2000
    assert params["key"] == str(["x", {"y": 1}, None])


def test_very_deep_files_are_skipped():
    assert workflows.parse_workflow("a: " + "[" * 5000 + "]" * 5000) is None


@pytest.mark.parametrize("uses", [40, 400, 1500])
def test_aliases_do_not_grow_the_rows(uses):
    import tracemalloc

    def bomb(n):
        return ("p: &p {" + ", ".join(f"k{k}: v" for k in range(n)) + "}\ns: &s [" + ", ".join(["{with: *p}"] * n) + "]\njobs: {"
                + ", ".join(f"j{k}: {{steps: *s}}" for k in range(n)) + "}\n")

    tracemalloc.start()
    try:
        assert workflows.read_workflow(bomb(uses)) == (None, workflows.OUTGROWN, 0) if uses > 40 else True
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3_000 * len(bomb(uses)) + 5_000_000


def test_long_texts_under_aliases_do_not_grow():
    content = "t: &t " + "x" * 100_000 + "\njobs: {a: {steps: [" + ", ".join(["{run: *t}"] * 10_000) + "]}}\n"
    assert workflows.read_workflow(content) == (None, workflows.OUTGROWN, 0)


def test_steps_shared_by_many_jobs_are_steps_of_each():
    content = "s: &s\n" + "".join(f"  - {{uses: a/b@v{k}, with: {{a: 1, b: 2, c: 3}}}}\n" for k in range(20)) + "jobs:\n" + "".join(f"  j{k}: {{steps: *s}}\n" for k in range(100))
    document, reason, _ = workflows.read_workflow(content)
    assert reason is None and [len(j["steps"]) for j in document["jobs"]] == [20] * 100


@pytest.mark.parametrize("content", ["{" + "a,b,c,d," * 500 + "}", "- " + "~, " * 5, "k: [" + "~," * 4000 + "]", 'k: "' + "\\x85" * 3000 + '"', "k: !!binary " + "AAAA" * 2000,
                                     "k: [" + "2024-01-01," * 1000 + "]", "k: {" + ", ".join(f"a{k}: {{}}" for k in range(900)) + "}"])
def test_files_without_aliases_have_room(content):
    steps = "".join(f"      - uses: {v}\n        run: {v}\n        with: {{x: {v}, y: {v}}}\n" for v in [content.removeprefix("k: ").removeprefix("- ")])
    document, reason, _ = workflows.read_workflow("jobs:\n  a:\n    steps:\n" + steps)
    assert reason in (None, workflows.NOT_YAML) and (document is None) == (reason is not None)


def test_rejects_are_listed(make_files):
    files = make_files(("ok.yml", "a: 1"), ("empty.yml", ""), ("list.yml", "- a"), ("cut.yml", "a: [1"), ("deep.yml", "a: " + "[" * 5000), ("date.yml", "a: 2024-13-45"), ("no.txt", "- a"))
    assert {(r.path, r.reason) for r in workflows.rejected_workflows(files).collect()} == {
        ("list.yml", "no mapping"), ("cut.yml", "not YAML"), ("deep.yml", "not YAML"), ("date.yml", "odd values")}
    assert {r.path for r in workflows.parse_workflows(files).collect()} == {"ok.yml", "empty.yml"}


def test_equal_files_are_read_once(monkeypatch):
    read, real = [], workflows.read_workflow
    monkeypatch.setattr(workflows, "read_workflow", lambda content: read.append(content) or real(content))
    reader = workflows._Reader()
    assert [len(results) for _, results in workflows._slices(["a: 1", "b: 2"] * 600, reader)] == [500, 500, 200]
    assert read == ["a: 1", "b: 2"]


def test_tasks_grow_with_the_text(make_files, monkeypatch):
    monkeypatch.setattr(workflows, "TASK_BYTES", 100)
    files = make_files(*[(f"{k}.yml", f"a{k}: " + "x" * 50) for k in range(20)])
    assert workflows._tasks(files) >= 10
    assert workflows.parse_workflows(files).count() == 20


USUAL = """---
name: CI  # comment
on: {push: {branches: [main, 'rel-*']}}
jobs:
  a:
    strategy: {matrix: {os: [x, y,], n: [1, 2.5, ~]}}
    steps:
      - uses: a/b@v1
        with: {ref: x, key:  "k-${{ hashFiles(x) }}"}
      - name: >-
          folded
            more
        run: |
          if [ -n "$x" ]; then
            ls *.py && make: x || exit 1  # no comment
          fi
  'b c':
    steps:
    - run: 'it''s
        two lines'
"""


def test_usual_files_need_no_slow_loader(monkeypatch):
    expected = yaml.load(USUAL, Loader=yaml.SafeLoader)
    monkeypatch.setattr(workflows.yaml, "SafeLoader", None)
    assert workflows._load(USUAL) == expected
    assert len(workflows.parse_workflow(USUAL)["jobs"]) == 2


@pytest.mark.parametrize("text", [
    "a: |# x\n  b\n", "a:\t b", "a: [b?c, ?d]", "%YAML 1.2\n---\na: b", "a: b\n---\nc: d", "--- a\n...\nb", "a: \x7f", "a: é", "a: &x 1\nb: *x", "a: !!str 1",
    "a: !x 1", "a: [!x 1]", "a: {b:,c}", "a: {b:?c}", 'a: "\\ud800"', "a: 'b\n--- c'", "a: [" * 400 + "]" * 400, "- " * 600 + "a", "[" * 20_000, "\r\na: b\r\n", "a: b\x85c: d"])
def test_odd_files_are_read_as_the_plain_loader_reads_them(text):
    def read(load):
        try:
            return repr(load(text))
        except (yaml.YAMLError, RecursionError) as error:
            return isinstance(error, yaml.YAMLError)

    assert read(workflows._load) == read(lambda t: yaml.load(t, Loader=yaml.SafeLoader))
