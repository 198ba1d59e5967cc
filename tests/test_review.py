"""Evidence, requests, replies and review records."""

import json

import pytest
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.functions.lines import is_safe_line, is_suspicious
from siftline.functions.redact import redact, redaction_changed
from siftline.functions.replies import first_json_object, reply_content, strict_json, strip_fence
from siftline.operators.evidence import evidence_blocks, pick_evidence, suspicious_lines
from siftline.operators.findings import static_findings
from siftline.operators.lines import chunks
from siftline.operators.replies import (
    bad_replies,
    chunk_findings,
    discovered_findings,
    discovery_reviews,
    intent_verdicts,
    parse_replies,
    review_records,
    review_stats,
    sum_stats,
)
from siftline.operators.requests import (
    chunk_requests,
    complete,
    discovery_requests,
    match_responses,
    pending_requests,
    review_requests,
    split_cached,
    with_context,
)
from siftline.operators.reviews import attach_reviews, keep_live_reviews, last_review

RESPONSE = "prompt_hash string, raw_text string, provider string, model string"


def answer(spark, requests, text):
    """Requests joined with the same reply to each of them."""
    replies = [(r.prompt_hash, text, "compatible", "m") for r in requests.select("prompt_hash").collect()]
    return match_responses(requests, spark.createDataFrame(replies, RESPONSE))


def texts(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").repartition(2)
    return [r.o for r in rows.select("i", column(F.col("t")).alias("o")).orderBy("i").collect()]


def test_first_json_object(spark):
    cases = {
        '{"a":1}': '{"a":1}',
        ' ﻿{"a":1}\n': '{"a":1}',
        'before\n{"a":1,"b":{"c":2}}\nafter': '{"a":1,"b":{"c":2}}',
        '```json\n{"ok":true}\n```': '{"ok":true}',
        'x {"a":"} \\" {"} y }': '{"a":"} \\" {"}',
        '{"a":1} and {"b":2}': None,  # starts and ends like one object, but is none
        '{"a":1': None,
        'see {"a":"open': None,
        "none": None,
        "{'a':1}": None,
        '{"a":NaN}': None,
        "": None,
    }
    assert texts(spark, list(cases), first_json_object) == list(cases.values())


def test_strict_json_and_fences(spark):
    assert texts(spark, ['{"a":1}', '{"a":1} x', "[1]"], strict_json) == ['{"a":1}', None, "[1]"]
    fenced = ["```json\n{}\n```", "```\n{}```  ", " {} ", "```json\n{}", "text ```{}```"]
    assert texts(spark, fenced, strip_fence) == ["{}", "{}", "{}", "{}", "text ```{}```"]


def test_reply_envelopes(spark):
    bodies = [
        json.dumps({"choices": [{"message": {"content": '{"a":1}'}}]}),
        json.dumps({"message": {"content": "text"}}),
        json.dumps({"message": {"content": {"a": 1}}}),
        json.dumps('{"a":1}'),
        '{"findings":[]}',
    ]
    assert texts(spark, bodies, reply_content) == ['{"a":1}', "text", '{"a":1}', '{"a":1}', '{"findings":[]}']


def test_redaction(spark):
    cases = {
        "-----BEGIN PRIVATE KEY-----\nABCDEF\n-----END PRIVATE KEY-----": "-----BEGIN PRIVATE KEY-----[已脱敏]-----END PRIVATE KEY-----",
        "Authorization: Bearer abcdefg12345": "Authorization: Bearer [已脱敏]",
        "API_KEY=abc token: x, mytoken=1": "API_KEY=[已脱敏] token: [已脱敏] mytoken=1",
        "password = 'quoted'": "password = 'quoted'",
        "密码token=abc": "密码token=[已脱敏]",
        "a eyJabcdefghij.abcdefghij.abcdefghij b": "a [已脱敏JWT] b",
        "plain": "plain",
    }
    assert texts(spark, list(cases), redact) == list(cases.values())
    assert texts(spark, list(cases), redaction_changed) == [k != v for k, v in cases.items()]
    # masked once more it reads the same, yet a rewrite took place
    assert texts(spark, ["token=x"], lambda t: redaction_changed(redact(t))) == [False]


def test_safe_and_suspicious_lines(spark):
    safe = ["", " \t ", "import os", "from x import y", "# c", "// c", "/* c", " * c", "x", "important", "fromage"]
    assert texts(spark, safe, is_safe_line) == [True] * 8 + [False] * 3
    lines = ["fetch (x)", "prefetch(x)", "os.environ", '"install": 1', "密码curl"]
    assert texts(spark, lines, lambda t: is_suspicious(t, F.lit("a.js"))) == [True, False, True, False, True]
    assert texts(spark, lines, lambda t: is_suspicious(t, F.lit("x/package.json"))) == [False, False, False, True, False]


def test_blocks_skip_overlaps_and_stop_at_the_limit(corpus):
    lines = ["x"] * 300
    for i in [0, 5, 17, 40, 60, 80, 100, 120, 140, 160]:
        lines[i] = "curl x"
    files = corpus(a_js="\n".join(lines))
    blocks = {m: [(b.start_line, b.end_line) for b in evidence_blocks(files, m).orderBy("block_no").collect()] for m in C.MAX_BLOCKS}
    assert blocks["targeted"] == [(1, 9), (10, 26), (33, 49), (53, 69), (73, 89), (93, 109)]
    assert len(blocks["balanced"]) == 8
    assert blocks["full"][-1] == (233, 249)  # sampled lines 1, 81, 161, 241


def test_blocks_of_skipped_lines(corpus):
    files = corpus(a_js="curl x // scan-ignore:other\n# curl\nx", b_js="# curl", c_js="")
    assert suspicious_lines(files).count() == 0
    assert [tuple(r) for r in suspicious_lines(files, "full").orderBy("path").collect()] == [("a.js", [2]), ("b.js", [1])]
    with pytest.raises(ValueError, match="unknown mode"):
        suspicious_lines(files, "some")


def test_blocks_split_at_both_kinds_of_line_ends(corpus):
    row = evidence_blocks(corpus(a_js="one\r\ncurl\r\nthree"), radius=1).collect()[0]
    assert (row.start_line, row.end_line, row.text) == (1, 3, "one\ncurl\nthree")


@pytest.mark.parametrize(
    ("start", "end", "picked"),
    [(None, None, "A"), (0, 0, "A"), (None, 25, "B"), (3, None, "A"), (10, 20, "A"), (15, 30, "B"), (11, 19, None), (90, 95, None)],
)
def test_evidence_for_a_span(spark, start, end, picked):
    blocks = F.array(
        *[F.struct(F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), F.lit(t).alias("text")) for a, b, t in [(1, 10, "A"), (20, 30, "B")]]
    )
    row = spark.range(1).select(pick_evidence(blocks, F.lit(start).cast("int"), F.lit(end).cast("int"))["text"].alias("t"))
    assert row.collect()[0].t == picked


def test_chunks(corpus):
    rows = chunks(corpus(a_js="\n".join(str(i) for i in range(1, 251)))).orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.start_line, len(r.chunk_lines), r.chunk_lines[0]) for r in rows] == [
        (0, 1, 100, "1"), (1, 101, 100, "101"), (2, 201, 50, "201"),
    ]


def test_requests_and_the_reply_store(spark, corpus):
    requests = discovery_requests(corpus(a_js="curl x token=abc", b_js="nothing"))
    row = requests.collect()[0]
    assert (requests.count(), row.path) == (1, "a.js")
    assert "token=[已脱敏]" in row.user_prompt
    none = spark.createDataFrame([], RESPONSE)
    assert [r.prompt_hash for r in pending_requests(requests, none).collect()] == [row.prompt_hash]
    stored = spark.createDataFrame([(row.prompt_hash, "{}", "compatible", None)], RESPONSE)
    answered, pending = split_cached(requests, stored)
    assert (answered.count(), pending.count()) == (1, 0)
    other_model = discovery_requests(corpus(a_js="curl x token=abc"), model="m").collect()[0]
    assert other_model.prompt_hash != row.prompt_hash
    assert pending_requests(requests.unionByName(requests), none).count() == 1


def test_discovery_replies(spark, corpus):
    requests = discovery_requests(corpus(a_js="x\ncurl y\nz"), radius=1)
    reply = {
        "findings": [
            {"title": "T", "category": " back/door ", "severity": "odd", "evidenceLineStart": 2, "attackScenario": "S"},
            {"title": "U", "category": "--", "severity": "high", "confidence": "high", "needsReview": False,
             "evidenceLineStart": 50, "evidenceSummary": "sum", "fix": "F"},
        ]
    }
    answered = answer(spark, requests, "Sure: " + json.dumps(reply) + " done")
    found = discovered_findings(answered).orderBy("k1").collect()
    assert [(f.rule_id, f.description, f.severity, f.line, f.snippet, f.suggestion) for f in found] == [
        ("LLM-DISC-BACK-DOOR", "T：S", "low", 2, "x\ncurl y\nz", None),
        ("LLM-DISC-UNKNOWN", "U", "high", 50, None, "F"),
    ]
    records = discovery_reviews(answered).orderBy("ord").collect()
    assert [(r.confidence, r.needs_review, r.evidence) for r in records] == [("low", True, "x\ncurl y\nz"), ("high", False, "sum")]
    assert review_stats(answered, "discovery").collect()[0].asDict() == {"calls": 1, "cache_hits": 1, "failures": 0}


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ('{"findings":[]}', False),
        ('{"findings":null}', False),
        ("{}", False),
        ('{"findings":{}}', True),
        ('{"findings":[{"title":"T"}]}', True),
        ('{"findings":[null]}', True),
        ('{"findings":[', True),
        ("nothing", True),
    ],
)
def test_failed_discovery_replies(spark, corpus, text, bad):
    answered = answer(spark, discovery_requests(corpus(a_js="curl")), text)
    assert discovered_findings(answered).count() == 0
    assert bad_replies(answered, "discovery").count() == int(bad)
    assert review_stats(answered, "discovery").collect()[0].failures == int(bad)


def test_review_replies(spark, corpus):
    files = corpus(a_js="verify=False\nhttp://x.y")
    findings = static_findings(files, C.BUILTIN_RULES)
    requests = review_requests(findings, files)
    reply = {"analyses": [{"index": 1, "severity": "critical", "summary": "S", "fix": "F"}, {"index": 0}, {"index": 7}, {"index": -1},
                          {"index": 0, "category": "late"}]}
    records = review_records(answer(spark, requests, json.dumps(reply)))
    rows = records.orderBy("ord").collect()
    fix_of = {r["id"]: r["fix"] for r in C.BUILTIN_RULES}
    assert [(r.id, r.title, r.category, r.severity, r.fix) for r in rows] == [
        ("SEC-212|a.js|1", "复核：S", "review", "critical", "F"),
        ("SEC-210|a.js|2", "复核：SEC-210", "review", "medium", fix_of["SEC-210"]),
        ("SEC-210|a.js|2", "复核：SEC-210", "late", "medium", fix_of["SEC-210"]),
    ]
    last = {r.key_rule: r.review.category for r in last_review(records).collect()}
    assert last == {"SEC-212": "review", "SEC-210": "late"}
    kept = keep_live_reviews(records, findings.filter("rule_id = 'SEC-212'")).collect()
    assert [r.related_rule_ids for r in kept] == [["SEC-212"]]
    attached = {f.rule_id: f.review and f.review.category for f in attach_reviews(findings, records.filter("category = 'late'")).collect()}
    assert attached == {"SEC-210": "late", "SEC-212": None}


def test_review_requests_fall_back_to_the_lines_around(spark, corpus):
    files = corpus(a_js="\n".join("abcdefghijklmnopqrstuvwxyz"))
    found = discovered_findings(
        answer(spark, discovery_requests(corpus(a_js="curl", b_js="curl")), '{"findings":[{"title":"T","category":"c","evidenceLineStart":20}]}')
    )
    rows = {r.path: r.context for r in with_context(found, files, 1).collect()}
    assert rows == {"a.js": "s\nt\nu", "b.js": ""}
    prompts = {r.path: r.user_prompt for r in review_requests(found, files, 1).collect()}
    assert '"snippet":"s\\nt\\nu"' in prompts["a.js"]
    assert '"snippet":""' in prompts["b.js"]


def test_chunk_replies(spark, corpus):
    files = corpus(a_js="\n".join(str(i) for i in range(1, 151)))
    requests = chunk_requests(files, C.BUILTIN_RULES)
    assert "- SEC-001: Eval text - " in requests.collect()[0].user_prompt
    reply = '```json\n{"findings":[{"ruleId":"X","severity":"odd","lineOffset":10,"confidence":0},{"ruleId":"Y","confidence":0.2}]}\n```'
    rows = chunk_findings(answer(spark, requests, reply)).orderBy("k1", "k2").collect()
    assert [(r.rule_id, r.severity, r.line, r.confidence) for r in rows] == [
        ("X", "odd", 11, 0.7), ("Y", None, 1, 0.2), ("X", "odd", 111, 0.7), ("Y", None, 101, 0.2),
    ]
    assert rows[0].snippet.split("\n") == ["8", "9", "10", "11", "12", "13", "14"]
    assert rows[1].snippet.split("\n") == ["1", "2", "3", "4"]


def test_intent_replies(spark, corpus):
    requests = chunk_requests(corpus(a_js="x"), [], intent=True)
    reply = {"findings": [{"ruleId": "I", "lineOffset": 0}], "intent_analysis": {
        "verdict": "malicious", "intent_mismatch": True, "reasoning": "R",
        "persistence": {"install_files": ["f"]}, "data_exfiltration": {}}}
    answered = answer(spark, requests, json.dumps(reply))
    row = intent_verdicts(answered).collect()[0]
    assert (row.verdict, row.intent_mismatch, row.deception_detected, row.reasoning) == ("MALICIOUS", True, None, "R")
    assert chunk_findings(answered, intent=True).collect()[0].rule_id == "I"
    safe = answer(spark, requests, '{"findings":[],"intent_analysis":{"verdict":"safe","reasoning":"R"}}')
    assert intent_verdicts(safe).collect()[0].reasoning is None
    broken = answer(spark, requests, "x" * 600)
    assert len(bad_replies(broken, "intent").collect()[0].raw_start) == 500


def test_completion_stage(spark, corpus):
    requests = discovery_requests(corpus(a_js="curl a", b_js="curl b", c_js="x"))
    pending = pending_requests(requests, spark.createDataFrame([], RESPONSE))

    def ask(system_prompt, user_prompt):
        if "b.js" in user_prompt:
            raise ValueError("no reply")
        return json.dumps({"findings": []})

    replies = complete(pending, ask, model="m", concurrency=2)
    assert sorted((r.raw_text or "", r.model) for r in replies.collect()) == [("", "m"), ('{"findings": []}', "m")]


def test_sum_stats(spark):
    one = spark.createDataFrame([(2, 1, 1)], "calls bigint, cache_hits bigint, failures bigint")
    assert sum_stats(one, one).collect()[0].asDict() == {"calls": 4, "cache_hits": 2, "failures": 2}
    assert sum_stats(one.limit(0)).collect()[0].calls == 0


def test_review_entries_before_a_bad_one_count(spark):
    items = "array<struct<ordinal:int,rule_id:string,severity:string,line:int,column:int,description:string,snippet:string,suggestion:string,context:string>>"
    one = (0, "SEC-001", "low", 1, None, "d", "s", "f", "c")
    reply = '{"analyses":[{"index":0,"category":"kept"},null,{"index":0,"category":"after"}]}'
    answered = spark.createDataFrame(
        [("a.js", [one], reply, "compatible", "m", "h", True)],
        f"path string, items {items}, raw_text string, provider string, model string, prompt_hash string, cache_hit boolean",
    )
    assert [r.category for r in review_records(answered).collect()] == ["kept"]
    assert [r.failed for r in parse_replies(answered, "review").collect()] == [True]
