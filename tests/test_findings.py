"""Findings of the built-in rules on small files, and sets of findings."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline import catalogue as C
from siftline.config import ScanConfig
from siftline.functions.text import signature
from siftline.operators.findings import diff_baseline, first_per_path, gate, scan_stats, static_findings
from siftline.operators.match import scan_regex

RULES = C.BUILTIN_RULES


def found(df):
    return sorted((r.path, r.line, r.rule_id) for r in df.collect())


@pytest.mark.parametrize(
    ("name", "line", "rules"),
    [
        ("a.js", 'const x = eval("code");', ["SEC-001", "SEC-101"]),
        ("a.js", 'const x = eval("code"); // scan-ignore', []),
        ("a.js", 'const x = eval("code"); // SCAN-IGNORE', []),
        ("a.js", "eval(x) // scan-ignore:SEC-001", ["SEC-101"]),
        ("a.js", "eval(x) // scan-ignore:SEC-1011", ["SEC-001"]),
        ("a.js", "eval(x) // scan-ignore:sec-999", ["SEC-001", "SEC-101"]),
        ("a.py", 'eval("code")', ["SEC-001"]),
        ("a.js", 'const x = JSON.parse("{}");', []),
        ("a.ts", 'const apiKey = "sk-abc123def456";', ["SEC-207"]),
        ("a.ts", "child_process.exec('rm -rf /');", ["SEC-003", "SEC-102"]),
        ("a.ts", 'const password = "admin123";', ["SEC-206"]),
        ("a.ts", "exec(`rm -rf /${userInput}`);", ["SEC-102"]),
        ("a.ts", 'export const SECRET_KEY = "sk-secret";', []),
        ("a.js", "document.getElementById('apiKey').value;", []),
        ("a.py", "subprocess.call(['rm', '-rf', '/tmp'])", ["SEC-003"]),
        ("a.py", 'PASSWORD = "default123"', ["SEC-206"]),
        ("a.py", "-----BEGIN RSA PRIVATE KEY-----", []),
        ("a.py", "密码token = 'abcdefgh99'", ["SEC-207"]),
    ],
)
def test_findings_on_one_line(spark, name, line, rules):
    corpus = spark.createDataFrame([(name, "first\n" + line + "\nlast")], "path string, content string")
    assert found(static_findings(corpus, RULES)) == [(name, 2, r) for r in rules]


def test_snippets_are_trimmed_and_carriage_returns_stay_in_lines(corpus):
    rows = scan_regex(corpus(a_js="x\r\n\u00a0\teval(1) \r\n"), RULES).collect()
    assert [(r.line, r.snippet) for r in rows] == [(2, "eval(1)")]


def test_one_finding_per_rule_and_line(corpus):
    assert found(scan_regex(corpus(a_js="eval(1); eval(2)\neval(3)"), RULES)) == [("a.js", 1, "SEC-001"), ("a.js", 2, "SEC-001")]


def test_rules_without_pattern_or_selector_find_nothing(corpus):
    rules = [
        {"id": "R1", "type": "regex", "severity": "high"},
        {"id": "A1", "type": "ast", "severity": "high"},
        {"id": "A2", "type": "ast", "severity": "high", "selector": "call:"},
        {"id": "A3", "type": "ast", "severity": "high", "selector": "tag:eval"},
        {"id": "L1", "type": "config", "severity": "high", "pattern": "eval"},
    ]
    assert static_findings(corpus(a_ts='eval("code")'), rules).count() == 0


def test_rules_that_need_look_around_are_tried_on_every_line(corpus):
    rules = [
        {"id": "L", "type": "regex", "severity": "low", "pattern": r"(?=.*\d)(?=.*[a-z]).{4,}"},
        {"id": "W", "type": "regex", "severity": "low", "pattern": r"token(?!s)"},
    ]
    assert found(scan_regex(corpus(a_js="abc\nab12\ntokens\nTOKEN"), rules)) == [("a.js", 2, "L"), ("a.js", 4, "W")]


def test_anchors_stand_for_the_ends_of_a_line(corpus):
    rules = [
        {"id": "S", "type": "regex", "severity": "low", "pattern": "^start"},
        {"id": "E", "type": "regex", "severity": "low", "pattern": "end$"},
        {"id": "A", "type": "regex", "severity": "low", "pattern": "^$"},
        {"id": "N", "type": "regex", "severity": "low", "pattern": r"\Bx\B|^\s*y"},
    ]
    text = "a start\nstart the end\n\nend.\n  y"
    assert found(scan_regex(corpus(a_js=text), rules)) == [("a.js", 2, "E"), ("a.js", 2, "S"), ("a.js", 3, "A"), ("a.js", 5, "N")]


def test_many_rules_take_several_groups(corpus, monkeypatch):
    from siftline.functions import patterns

    monkeypatch.setattr(patterns, "GROUP", 2)
    rules = [{"id": f"R{i}", "type": "regex", "severity": "low", "pattern": f"x{i}"} for i in range(5)]
    rows = scan_regex(corpus(a_js="x0 x4\nx3"), rules).collect()
    assert sorted((r.rule_id, r.line, r.k1) for r in rows) == [("R0", 1, 0), ("R3", 2, 3), ("R4", 1, 4)]


def test_a_pack_too_large_for_one_pattern_is_split(corpus, monkeypatch):
    from siftline.functions import patterns

    accepts = patterns.re2_accepts
    monkeypatch.setattr(patterns, "re2_accepts", lambda p: p.count("(?:") <= 2 and accepts(p))
    rules = [{"id": f"R{i}", "type": "regex", "severity": "low", "pattern": f"x{i}"} for i in range(7)]
    rules.append({"id": "C", "type": "ast", "severity": "low", "selector": "call:x9"})
    text = "x0 x4\nx3 x6; x9(1)"
    assert found(static_findings(corpus(a_js=text), rules)) == [("a.js", 1, "R0"), ("a.js", 1, "R4"), ("a.js", 2, "C"), ("a.js", 2, "R3"), ("a.js", 2, "R6")]


def test_quotes_and_backslashes_in_rules(corpus):
    rules = [{"id": "it's", "type": "regex", "severity": "low", "pattern": r"""'\\["%_]""", "description": "a\\'b", "fix": None}]
    row = scan_regex(corpus(a_js="x '\\% y"), rules).collect()[0]
    assert (row.rule_id, row.description, row.suggestion) == ("it's", "a\\'b", None)


def plain(pattern):
    """The pattern for Python's own engine."""
    return pattern.replace(r"\s", r"[\s\u00a0\ufeff]").replace(".*", r"[^\n\r\u2028\u2029]*")


LINES = st.lists(
    st.lists(
        st.sampled_from(
            ["eval(", "token", "='", "abcdefgh", "'", "\u00a0", " ", "\r", "ignore", "all", "rules", "SELECT", "+", "FROM", "é", "\u212a", "x"]
        ),
        max_size=6,
    ).map("".join),
    max_size=5,
)


@settings(max_examples=15, deadline=None)
@given(st.lists(LINES, min_size=1, max_size=6))
def test_regex_scan_against_trying_every_rule_on_every_line(spark, files):
    texts = ["\n".join(lines) for lines in files]
    expected = []
    for number, text in enumerate(texts):
        for line_no, line in enumerate(text.split("\n"), 1):
            for rule in RULES:
                if rule["type"] == "regex" and re.search(plain(rule["pattern"]), line, re.IGNORECASE | re.ASCII):
                    expected.append((str(number), line_no, rule["id"]))
    corpus = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    assert found(scan_regex(corpus, RULES)) == sorted(expected)


def test_baseline_drops_every_copy_of_a_known_finding(spark, corpus):
    findings = static_findings(corpus(a_js="eval(1)\neval(2)"), RULES)
    known = spark.createDataFrame([("SEC-001|a.js|1|eval(1)",), ("SEC-001|a.js|1|eval(1)",)], "signature string")
    assert found(diff_baseline(findings, known)) == [("a.js", 1, "SEC-101"), ("a.js", 2, "SEC-001"), ("a.js", 2, "SEC-101")]
    assert diff_baseline(findings, known.limit(0)).count() == 4


def test_signature_of_a_finding_without_line_and_snippet(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(signature(F.lit("R"), F.lit("p"), F.lit(None).cast("int"), F.lit(None).cast("string")).alias("s"))
    assert row.collect()[0].s == "R|p|0|"


def test_gate(corpus):
    findings = static_findings(corpus(a_js="verify = False"), RULES)  # medium
    assert [gate(findings, t).collect()[0].failed for t in (None, "low", "medium", "high", "odd")] == [True, True, True, False, True]
    assert gate(findings.limit(0)).collect()[0].failed is False


def test_first_findings_follow_report_order_and_cut_before_the_shuffle(corpus):
    text = "\n".join(["http://a.b verify=False"] * 10)
    rows = first_per_path(scan_regex(corpus(a_js=text), RULES), 3)
    assert [(r.ordinal, r.rule_id, r.line) for r in sorted(rows.collect(), key=lambda r: r.ordinal)] == [
        (0, "SEC-210", 1), (1, "SEC-210", 2), (2, "SEC-210", 3),
    ]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scan_stats_of_an_empty_corpus(corpus):
    empty = corpus(a_js="x").limit(0)
    row = scan_stats(empty, static_findings(empty, RULES)).collect()[0]
    assert (row.files_scanned, row.issues_found) == (0, 0)


def test_presets_choose_rules():
    counts = {p["name"]: len(ScanConfig.create(p["name"]).choose(RULES)) for p in C.PRESETS}
    assert counts == {"strict": 38, "balanced": 22, "development": 13, "ai-focused": 16, "owasp-only": 5}


def test_settings_replace_what_a_preset_set():
    config = ScanConfig.create("balanced", enabled_groups=["tls"], fail_on="low")
    assert (config.enabled_groups, config.fail_on) == (["tls"], "low")
    assert ScanConfig().fail_on is None
    with pytest.raises(ValueError, match="unknown preset"):
        ScanConfig.create("nothing")


def test_rules_without_a_group_vanish_once_groups_are_chosen():
    rules = [{"id": "A", "group": None}, {"id": "B", "group": "g"}]
    assert [r["id"] for r in ScanConfig(enabled_groups=["g"]).choose(rules)] == ["B"]
    assert len(ScanConfig(enabled_groups=[]).choose(rules)) == 2


def test_a_long_line_is_only_tried_with_the_rules_found_on_it(corpus):
    line = "write " * 60_000 + "eval(1)"
    rows = scan_regex(corpus(a_js=line), RULES).collect()
    assert [(r.rule_id, len(r.snippet)) for r in rows] == [("SEC-001", len(line))]


def test_one_file_may_hold_nearly_all_findings(corpus):
    text = "\n".join(["http://a.b"] * 20_000)
    findings = scan_regex(corpus(hot_js=text, a_js="http://a.b"), RULES)
    assert findings.count() == 20_001
    assert first_per_path(findings).groupBy("path").count().orderBy("path").collect() == [("a.js", 1), ("hot.js", 8)]


def test_the_corpus_is_read_once_for_both_engines(corpus):
    plan = static_findings(corpus(a_js="x"), RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan


def test_many_selectors_are_joined_not_listed(corpus):
    from siftline.operators.calls import scan_calls

    rules = [{"id": f"R{i}", "type": "ast", "selector": f"call:name{i}", "severity": "low"} for i in range(5000)]
    rules += [{"id": "DOTTED", "type": "ast", "selector": "call:lib.name7", "severity": "low"}]
    files = corpus(a_js="name7(1); x.lib.name7(2)\nxname7(3); name7.other(); lib\n.name7(4)", b_py="name7(1)")
    called = scan_calls(files, rules)
    assert "BroadcastHashJoin" in called._jdf.queryExecution().executedPlan().toString()
    for found_ in (called, static_findings(files, [*rules, RULES[0]])):
        assert found_._jdf.queryExecution().optimizedPlan().toString().count("name4999") <= 2  # a constant row
        assert found(found_) == [("a.js", 1, "DOTTED"), ("a.js", 1, "R7"), ("a.js", 1, "R7"), ("a.js", 2, "R7")]
