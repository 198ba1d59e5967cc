"""The whole scan and its reports."""

import json
from pathlib import Path

import pytest

from siftline import catalogue as C
from siftline.config import ScanConfig
from siftline.operators.findings import order_findings, scan_stats
from siftline.operators.match import scan_regex
from siftline.operators.report import json_lines, markdown_lines, sarif_lines, write_report
from siftline.operators.scanners import FileScanner, scan_files
from siftline.plans.scan import scan
from siftline.sources.baseline import signatures
from siftline.sources.corpus import read_corpus, read_files
from siftline.sources.responses import read_responses

RULES = C.BUILTIN_RULES


def text_of(place):
    parts = sorted(p for p in Path(place).iterdir() if p.name.startswith("part-"))
    return "".join(p.read_text() for p in parts)


def reviewer():
    """A model that always says the same; defined inside so that it travels to the tasks."""

    def ask(system_prompt, user_prompt):
        if '"analyses"' in system_prompt:
            return '{"analyses":[{"index":0,"category":"checked","confidence":"high","summary":"A \\"quoted\\" one"}]}'
        if "bad.py" in user_prompt:
            return "{"
        return '{"findings":[{"title":"Hidden","category":"door","severity":"critical","evidenceLineStart":1}]}'

    return ask


ask = reviewer()


@pytest.fixture
def files(corpus):
    return corpus(a_js='eval("1")\nok', b_py="subprocess.call(x)", bad_py="curl x", c_py="clean")


def test_static_scan(files):
    result = scan(files, RULES, ScanConfig.create(preset="development"))
    assert sorted((r.path, r.rule_id) for r in result.findings.collect()) == [("a.js", "SEC-001"), ("a.js", "SEC-101")]
    assert result.stats.collect()[0].asDict() == {"files_scanned": 4, "issues_found": 2}
    assert result.failed.collect()[0].failed is True
    assert result.reviews is None


def test_scan_against_a_baseline(files):
    known = signatures(scan(files, RULES).findings.filter("path = 'a.js'"))
    result = scan(files, RULES, baseline=known)
    assert [r.path for r in result.findings.collect()] == ["b.py"]
    assert scan(files, RULES, baseline=signatures(scan(files, RULES).findings)).failed.collect()[0].failed is False


def test_scan_of_a_directory_and_a_file(spark, tmp_path):
    (tmp_path / "safe.js").write_text('const x = JSON.parse("{}");')
    (tmp_path / "vuln.js").write_text('const y = eval("code");')
    result = scan(read_corpus(spark, str(tmp_path)), RULES)
    assert result.stats.collect()[0].asDict() == {"files_scanned": 2, "issues_found": 2}
    result = scan(read_corpus(spark, str(tmp_path / "vuln.js")), RULES)
    assert {r.rule_id for r in result.findings.collect()} == {"SEC-001", "SEC-101"}


def test_reviewed_scan_then_replay_from_the_store(spark, files, tmp_path):
    store = str(tmp_path / "store")
    result = scan(files, RULES, ask=ask, store=store)
    found = sorted((r.path, r.rule_id) for r in result.findings.collect())
    assert found == [
        ("a.js", "LLM-DISC-DOOR"), ("a.js", "SEC-001"), ("a.js", "SEC-101"), ("b.py", "LLM-DISC-DOOR"), ("b.py", "SEC-003"),
    ]
    records = sorted((r.path, r.stage, r.category) for r in result.reviews.collect())
    assert records == [("a.js", 0, "door"), ("a.js", 1, "checked"), ("b.py", 0, "door"), ("b.py", 1, "checked")]
    assert result.review_stats.collect()[0].asDict() == {"calls": 5, "cache_hits": 0, "failures": 1}

    again = scan(files, RULES, responses=read_responses(spark, store))
    assert sorted((r.path, r.rule_id) for r in again.findings.collect()) == found
    assert again.review_stats.collect()[0].asDict() == {"calls": 5, "cache_hits": 5, "failures": 1}


def test_discovered_findings_fail_the_gate_only_when_asked_to(corpus):
    files = corpus(a_py="curl x")
    assert scan(files, RULES, ask=ask).failed.collect()[0].failed is False
    assert scan(files, RULES, ScanConfig(include_discovered=True), ask=ask).failed.collect()[0].failed is True


def test_baseline_also_drops_reviews(files):
    first = scan(files, RULES, ask=ask)
    rest = scan(files, RULES, ask=ask, baseline=signatures(first.findings.filter("path = 'a.js'")))
    assert {r.path for r in rest.reviews.collect()} == {"b.py"}


def test_max_files_limits_discovery(files):
    result = scan(files, RULES, ScanConfig(max_files=1), ask=ask)
    assert {r.path for r in result.findings.filter("phase = 1").collect()} == {"a.js"}


def test_reports(files, tmp_path):
    result = scan(files, RULES, ask=ask)
    lines = {
        "json": json_lines(result.findings, result.stats, result.reviews, result.review_stats),
        "sarif": sarif_lines(result.findings, result.reviews),
        "md": markdown_lines(result.findings, result.stats, result.reviews),
    }
    for name, rows in lines.items():
        write_report(rows, str(tmp_path / name))

    report = json.loads(text_of(tmp_path / "json"))
    assert report["stats"] == {"filesScanned": 4, "issuesFound": 5}
    assert [(f["file"], f["ruleId"]) for f in report["vulnerabilities"]] == [
        ("a.js", "SEC-001"), ("a.js", "SEC-101"), ("b.py", "SEC-003"), ("a.js", "LLM-DISC-DOOR"), ("b.py", "LLM-DISC-DOOR"),
    ]
    assert "column" not in report["vulnerabilities"][0]
    assert report["llm"]["stats"] == {"calls": 5, "cacheHits": 0, "failures": 1}
    assert [f["title"] for f in report["llm"]["findings"]] == ["Hidden", "Hidden", '复核：A "quoted" one', '复核：A "quoted" one']

    sarif = json.loads(text_of(tmp_path / "sarif"))
    run = sarif["runs"][0]
    assert sarif["version"] == "2.1.0"
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["SEC-001", "SEC-101", "SEC-003", "LLM-DISC-DOOR"]
    first = run["results"][0]
    assert (first["level"], first["locations"][0]["physicalLocation"]["region"]) == ("error", {"startLine": 1})
    assert first["properties"]["llm"]["category"] == "checked"
    assert "properties" not in run["results"][1]

    text = text_of(tmp_path / "md")
    assert "## 5 problems found" in text
    assert text.index("### [CRITICAL] SEC-001") < text.index("### [HIGH] SEC-003") < text.index("## Review records")
    assert text.count("**Evidence**") == 4


def test_own_scanners_and_report_order(files):
    def long_names(corpus):
        own = [{"id": "OWN", "type": "regex", "severity": "low", "pattern": "^clean$", "description": "d", "fix": "f"}]
        return scan_regex(corpus, own)

    rows = order_findings(scan(files, RULES, scanners=[long_names]).findings).collect()
    assert [(r.path, r.rule_id) for r in rows] == [("a.js", "SEC-001"), ("a.js", "SEC-101"), ("b.py", "SEC-003"), ("c.py", "OWN")]


def test_empty_reports(files, tmp_path):
    none = scan(files.filter("path = 'c.py'"), RULES)
    write_report(json_lines(none.findings, none.stats), str(tmp_path / "json"))
    write_report(sarif_lines(none.findings), str(tmp_path / "sarif"))
    write_report(markdown_lines(none.findings, none.stats), str(tmp_path / "md"))
    assert json.loads(text_of(tmp_path / "json"))["vulnerabilities"] == []
    assert json.loads(text_of(tmp_path / "sarif"))["runs"][0]["results"] == []
    assert "No problems found" in text_of(tmp_path / "md")


def test_each_request_is_asked_once(corpus, tmp_path):
    log = str(tmp_path / "asked")

    def ask(system_prompt, user_prompt):
        with open(log, "a") as out:
            out.write("x")
        return '{"findings":[],"analyses":[]}'

    files = corpus(**{f"f{i}_py": "curl x" for i in range(6)})
    result = scan(files, RULES, ask=ask)
    assert result.findings.count() == 0
    assert result.review_stats.collect()[0].calls == 6
    assert Path(log).stat().st_size == 6


def test_files_that_cannot_be_read_are_counted_and_reported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.js", "eval(1)"), ("long.js", "x" * 60), ("_long.js", "y" * 60)):
        (tmp_path / "in" / name).write_text(text)
    result = scan(read_files(spark, str(tmp_path / "in"), max_bytes=50), RULES)
    assert result.stats.collect()[0].asDict() == {"files_scanned": 1, "issues_found": 2, "files_unread": 2}
    assert sorted(map(tuple, result.unread.collect())) == [("_long.js", "too long"), ("long.js", "too long")]
    write_report(json_lines(result.findings, result.stats, unread=result.unread), str(tmp_path / "json"))
    write_report(sarif_lines(result.findings, unread=result.unread), str(tmp_path / "sarif"))
    write_report(markdown_lines(result.findings, result.stats, unread=result.unread), str(tmp_path / "md"))
    report = json.loads(text_of(tmp_path / "json"))
    assert report["stats"] == {"filesScanned": 1, "issuesFound": 2, "filesUnread": 2}
    assert report["unread"] == [{"file": "_long.js", "reason": "too long"}, {"file": "long.js", "reason": "too long"}]
    run = json.loads(text_of(tmp_path / "sarif"))["runs"][0]
    notes = run["invocations"][0]["toolExecutionNotifications"]
    assert [n["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for n in notes] == ["_long.js", "long.js"]
    assert len(run["results"]) == 2
    assert "## 2 files could not be read\n\n- `_long.js`: too long" in text_of(tmp_path / "md")


def test_a_corpus_without_a_table_of_unread_files_fails_on_one(spark, tmp_path):
    (tmp_path / "_a.py").write_text("x")
    files = read_corpus(spark, str(tmp_path))
    (tmp_path / "_a.py").unlink()
    with pytest.raises(Exception, match="cannot read _a.py"):
        files.collect()


def careful():
    """Scanners that fail on some files; defined inside so that they travel to the tasks."""

    def shouts(path, content):
        for number, line in enumerate(content.split("\n"), 1):
            if "!" in line:
                yield {"rule_id": "LOUD", "severity": "high", "line": number, "snippet": line}
            if line == "boom":
                raise ValueError("cannot read boom")

    def odd(path, content):
        return [{"rule_id": "ODD", "line": "x"}] if path == "b.py" else [7] if path == "c.py" else None

    return [FileScanner("shouts", shouts), FileScanner("odd", odd)]


def test_a_scanner_that_fails_on_a_file_costs_that_file_only(spark):
    rows = [("a.js", 'eval("1")!\nno\nyes!'), ("b.py", "hey!\nboom\neval(!"), ("c.py", ""), ("d.py", None), ("e.py", "!\n" * 3000)]
    docs = spark.createDataFrame(rows, "path string, content string")
    result = scan(docs, RULES, scanners=careful())
    mine = [(r.path, r.line, r.k2) for r in result.findings.where("rule_id = 'LOUD'").orderBy("path", "line").collect()]
    assert mine[:2] == [("a.js", 1, 0), ("a.js", 3, 1)]
    assert mine[2:] == [("e.py", i, i - 1) for i in range(1, 3001)]
    assert {(r.path, r.rule_id) for r in result.findings.where("engine < 3").collect()} >= {("a.js", "SEC-001"), ("b.py", "SEC-001")}
    errors = {(r.path, r.scanner): r.reason for r in result.scanner_errors.collect()}
    assert set(errors) == {("b.py", "shouts"), ("b.py", "odd"), ("c.py", "odd")}
    assert errors["b.py", "shouts"] == "cannot read boom"
    assert "not a finding" in errors["c.py", "odd"]
    assert scan(docs, RULES).scanner_errors is None
    nothing = scan_files(docs.limit(0), careful())
    assert [part.count() for part in nothing] == [0, 0]


def test_durations_of_a_scan_and_of_its_review(files, tmp_path):
    result = scan(files, RULES, ask=ask)
    assert 0 < result.review_ms <= result.duration_ms
    rows = json_lines(result.findings, result.stats, result.reviews, result.review_stats, None, result.duration_ms, result.review_ms)
    write_report(rows, str(tmp_path / "json"))
    report = json.loads(text_of(tmp_path / "json"))
    assert report["stats"]["durationMs"] == result.duration_ms
    assert report["llm"]["stats"]["durationMs"] == result.review_ms
    assert scan(files, RULES).review_ms == 0


def test_counting_files_reads_no_text(spark, tmp_path):
    place = str(tmp_path / "docs")
    spark.createDataFrame([("a.js", "x"), ("b.js", "y")], "path string, content string").write.parquet(place)
    docs = spark.read.parquet(place)
    stats = scan_stats(docs, scan(docs, RULES).findings)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<>" in plan
    assert stats.collect()[0].files_scanned == 2
