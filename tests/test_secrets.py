"""Secret rules: lines, gates, redaction.  Tokens are put together here so the repository holds none."""

import re

import pytest

from fleetsift import fixed_values as V
from fleetsift.operators import secrets
from fleetsift.sources.secret_rules import BUILT_IN, SecretRule

HEX = "0123456789abcdef" * 4
SAMPLES = {
    "SEC001": "AK" + "IA" + "A1B2C3D4E5F6G7H8",
    "SEC002": "aws_secret = " + HEX[:40],
    "SEC003": "gh" + "p_" + HEX[:36],
    "SEC004": "gh" + "o_" + HEX[:36],
    "SEC005": "gh" + "r_" + HEX[:36],
    "SEC006": "Api-Key: '" + HEX[:20] + "'",
    "SEC007": "-----BEGIN " + "EC PRIVATE KEY-----",
    "SEC008": "ey" + "Jab.cd.ef",
    "SEC009": "xo" + "xp-" + HEX[:12],
    "SEC010": "AI" + "za" + HEX[:35],
    "SEC011": "sk" + "_test_" + HEX[:24],
    "SEC012": 'PASSWD = "' + HEX[:9] + '"',
    "SEC013": "redis" + "://u:p@h",
    "SEC014": "//registry.npmjs.org/:" + "_authToken=" + HEX[:8],
    "SEC015": "docker hub token: '" + HEX[:9] + "'",
}


def brute_force(content):
    """Line by line, rule by rule, with Python's own patterns."""
    found = []
    for number, line in enumerate(content.splitlines(), 1):
        for rule in V.SECRET_RULES:
            found += [(number, rule[0], i, m.group(0)[:4] + "***") for i, m in enumerate(re.finditer(rule[2], line))]
    return sorted(found)


def found_in(make_files, content, rules=BUILT_IN, path="a.py"):
    rows = secrets.match_secrets(make_files((path, content)), rules).collect()
    return sorted((r.line_number, r.rule_id, r.match_index, r.redacted) for r in rows)


@pytest.mark.parametrize("rule_id", list(SAMPLES))
def test_each_rule_alone(make_files, rule_id):
    content = "first\n\n" + SAMPLES[rule_id] + "\nlast"
    assert (3, rule_id, 0, SAMPLES[rule_id][:4] + "***") in found_in(make_files, content)
    assert found_in(make_files, content) == brute_force(content)


def test_all_rules_many_breaks_and_repeats(make_files):
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\u2029"]
    content = "".join(s + " and again " + s + breaks[i % len(breaks)] for i, s in enumerate(SAMPLES.values()))
    assert found_in(make_files, content) == brute_force(content)
    assert len(brute_force(content)) >= 30


@pytest.mark.parametrize("content", [
    "pa\u017fsword = 'abcdefgh'", "PA\u017fSWD: \"longenough\"", "DOC\u212aER token: 'abcdefgh1'", "red\u0130s://u:p@h", "m\u0131 red\u0131s://u:p@h",
    "password\u00a0=\u00a0'abcdefgh'", "密码 password = 'пароль-длинный'", "aws" + "." * 20 + "secret" + "\u2003=" + HEX[:40]])
def test_odd_letters_and_spaces_as_in_python(make_files, content):
    assert found_in(make_files, content) == brute_force(content)


def test_user_rule_without_hint_and_with_anchor(make_files):
    rule = SecretRule("U1", "n", r"^tok_\d+$", "LOW", "d")
    assert found_in(make_files, "tok_1\nx tok_2\ntok_3", [rule]) == [(1, "U1", 0, "tok_***"), (3, "U1", 0, "tok_***")]
    both = found_in(make_files, "tok_1\n" + SAMPLES["SEC001"], [*BUILT_IN, rule])
    assert [(r[0], r[1]) for r in both] == [(1, "U1"), (2, "SEC001")]


def test_rule_that_refers_to_its_own_group(make_files):
    rule = SecretRule("U2", "n", r"(['\"])(?:tok)\1", "LOW", "d", hints=("tok",))
    content = "x 'tok' y\n'tok\"\n" + SAMPLES["SEC001"]
    assert [(r[0], r[1]) for r in found_in(make_files, content, [*BUILT_IN, rule])] == [(1, "U2"), (3, "SEC001")]
    assert [(r[0], r[1]) for r in found_in(make_files, content, [rule])] == [(1, "U2")]


def test_unscannable_file_and_high_risk_name(make_files):
    assert found_in(make_files, SAMPLES["SEC001"], path="a.md") == []
    rows = secrets.secret_findings(make_files(("x/.npmrc", SAMPLES["SEC001"]), ("x/a.py", SAMPLES["SEC001"]))).collect()
    assert {(r.file_path, r.confidence) for r in rows} == {("x/.npmrc", "HIGH"), ("x/a.py", "MEDIUM")}
    assert all(SAMPLES["SEC001"] not in str(r) for r in rows)


def test_no_rule_shuffles_the_contents(make_files):
    plan = secrets.match_secrets(make_files(("a.py", "x")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
