"""Pattern translation, word lists and globs."""

import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.functions.globs import expand_braces, glob_regex, name_glob
from siftline.functions.patterns import GROUP, any_of, index_words, literal_word, required_words, search_pattern, to_java, to_re2
from siftline.operators.findings import static_findings
from siftline.operators.lines import explode_lines
from siftline.operators.match import rule_matches, scan_regex


def java_matches(spark, pattern, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r.m for r in rows.select(F.col("t").rlike(pattern).alias("m")).collect()]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        (r"\btoken", ["密码token=1", "token", "(token"], ["atoken", "_token", "1token"]),
        (r"a\sb", ["a b", "a\u00a0b", "a\ufeffb", "a\x0bb"], ["ab", "a_b"]),
        (r"a.b", ["axb", "a\u0085b"], ["a\nb", "a\rb", "a\u2028b"]),
        (r"end$", ["the end"], ["end\n", "end x"]),
        (r"[[]x", ["[x"], ["x", "]x"]),
        (r"a{b", ["a{b"], ["ab"]),
        (r"[^]x", ["\nx", "ax"], ["x"]),
        (r"\e\a", ["ea"], ["\x1b\x07"]),
        (r"a\vb", ["a\x0bb"], ["a\nb"]),
        (r"\(\b(?:eval|exec)\b", ["(eval"], ["(evals"]),
    ],
)
def test_to_java_reads_patterns_like_ecmascript(spark, pattern, yes, no):
    java = to_java(pattern)
    assert java_matches(spark, java, yes) == [True] * len(yes)
    assert java_matches(spark, java, no) == [False] * len(no)
    # the RE2 form may match more, never less
    found = pc.match_substring_regex(pa.array(yes), to_re2(pattern), ignore_case=True).to_pylist()
    assert found == [True] * len(yes)


def test_ignoring_case_beyond_ascii(spark):
    assert java_matches(spark, "(?i)" + to_java("é(x)"), ["ÉX", "éx", "ex"]) == [True, True, False]


def test_every_builtin_pattern_has_a_search_pattern():
    patterns = [r["pattern"] for r in C.BUILTIN_RULES if r["type"] == "regex"] + C.SUSPICIOUS_PATTERNS
    assert all(search_pattern(p) for p in patterns)


def test_search_pattern_falls_back_to_words_then_to_nothing():
    assert search_pattern(r"secret(?!s)\d") == "secret"
    assert search_pattern(r"(?=.*\d)(?=.*[a-z]).{8,}") == ""


@pytest.mark.parametrize("rule", [r for r in C.BUILTIN_RULES if r["type"] == "regex"], ids=lambda r: r["id"])
def test_required_words_hold_on_planted_lines(rule):
    from checks.planted import PLANTED_LINES

    words = required_words(rule["pattern"])
    hits = [line for line in PLANTED_LINES if re.search(rule["pattern"], line, re.IGNORECASE)]
    assert hits
    assert words
    assert all(any(w in line.lower() for w in words) for line in hits)


def test_any_of_matches_what_its_patterns_match(spark):
    texts = ["eval (x)", "retrieval(x)", "see http://x", "xhttp://x", "use curl", "curly", "tool may execute", ""]
    whole = java_matches(spark, any_of(C.SUSPICIOUS_PATTERNS), texts)
    assert whole == [True, False, True, False, True, False, True, False]


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("**/*.{js,ts}", ["a.js", "x/y/b.ts"], ["a.jsx", "a.py", ".hidden/a.js", "x/.a.js"]),
        ("src/*.py", ["src/a.py"], ["src/x/a.py", "a.py"]),
        ("**/test/**", ["test/a.js", "x/test/y/a.js"], ["tests/a.js", "x/atest/a.js"]),
        ("a?.[ch]", ["ab.c", "ax.h"], ["a.c", "abc.h"]),
    ],
)
def test_globs(spark, glob, yes, no):
    regex = glob_regex(glob)
    assert java_matches(spark, regex, yes) == [True] * len(yes)
    assert java_matches(spark, regex, no) == [False] * len(no)


def test_exclude_globs_reach_hidden_names(spark):
    assert java_matches(spark, glob_regex("**/dist/**", dot=True), [".x/dist/.a.js"]) == [True]


def test_brace_expansion_and_name_globs():
    assert expand_braces("{a,b}/{c,d}.x") == ["a/c.x", "a/d.x", "b/c.x", "b/d.x"]
    assert name_glob(["**/*.{js,ts}"]) == "*.{js,ts}"
    assert name_glob(["**"]) is None


@pytest.mark.parametrize(
    ("pattern", "line"),
    [
        (r"\x2D\b[a-z]+", "run --verbose"),
        (r"-\b[a-z]+", "run --verbose"),
        (r"(a)\1\b!?", "x aa y"),
        (r"a\b", "a-b"),
        (r"foo[^\S\n]bar", "foo bar"),
        (r"foo[\s]bar", "foo　bar"),
        (r"x[^\s]y", "x​y"),
        (r"secret(?!s)\d", "secret7"),
    ],
)
def test_custom_patterns_match_and_are_searched_for(corpus, pattern, line):
    rules = [{"id": "R", "type": "regex", "severity": "low", "pattern": pattern}]
    assert [r.line for r in scan_regex(corpus(a_js=f"nothing\n{line}"), rules).collect()] == [2]


def test_a_bad_pattern_is_named_before_the_scan(corpus):
    rules = [{"id": "GOOD", "type": "regex", "severity": "low", "pattern": "a"}, {"id": "BAD-1", "type": "regex", "severity": "low", "pattern": "(abc"}]
    with pytest.raises(ValueError, match="BAD-1"):
        scan_regex(corpus(a_js="x"), rules)


def test_a_thousand_rules_read_the_corpus_once(spark, tmp_path):
    place = str(tmp_path / "docs")
    spark.createDataFrame([("a.js", "w7 w999\nzz")], "path string, content string").write.parquet(place)
    rules = [{"id": f"R{i}", "type": "regex", "severity": "low", "pattern": rf"\bw{i}\b"} for i in range(1000)]
    rules.append({"id": "LOOK", "type": "regex", "severity": "low", "pattern": r"(?<=z)z"})
    found = scan_regex(spark.read.parquet(place), rules)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((r.rule_id, r.line) for r in found.collect()) == [("LOOK", 2), ("R7", 1), ("R999", 1)]


def low(patterns):
    return [{"id": f"R{i}", "type": "regex", "severity": "low", "pattern": p} for i, p in enumerate(patterns)]


def test_a_large_pack_finds_what_each_rule_finds_alone(spark):
    from checks.planted import CUSTOM_RULES, PLANTED_LINES

    few = [r["pattern"] for r in [*C.BUILTIN_RULES, *CUSTOM_RULES] if r["type"] == "regex" and r.get("pattern")]
    few += [r"\aBCD", r"(?<=z)z", "ab", "abc", "bcd|cde", "ÄÖabc", r"x\x2Dray", r"foo[\s]bar", r"(abc|abd)e", "KEYS", "^$"]
    patterns = few + [rf"\bw{i}\b" for i in range(GROUP)]
    texts = ["\n".join(PLANTED_LINES), "", None, "\n", "ÄÖABC İabcde\nzz abd\nx-RAY é w7 w7 w77", "w199\r\nfoo\u3000bar", "K\u017feys keyſ KEYS", "aBCD\n\n" + "é😀 " * 5000 + "abcd\nw12"]
    docs = spark.createDataFrame([(f"{i}.txt", t) for i, t in enumerate(texts)], "path string, content string")
    lines = explode_lines(docs).selectExpr("path", "line_no", "line AS text")
    alone = set()
    tests = [F.expr(rule_matches(r)).alias(r["id"]) for r in low(patterns)]
    for row in lines.select("path", "line_no", *tests).collect():
        alone |= {(row.path, row.line_no, f"R{i}") for i in range(len(patterns)) if row[f"R{i}"]}
    lines_of_marker = {(r.path, r.line_no) for r in lines.filter("lower(text) LIKE '%scan-ignore%'").collect()}
    got = [(r.path, r.line, r.rule_id) for r in scan_regex(docs, low(patterns)).collect()]
    assert len(got) == len(set(got))
    assert {g for g in got if g[:2] not in lines_of_marker} == {a for a in alone if a[:2] not in lines_of_marker}
    assert {f"R{i}" for i in range(len(few))} - {r for _, _, r in got} == {"R" + str(i) for i in range(len(few)) if f"R{i}" not in {r for _, _, r in alone}}


def test_words_of_an_index_are_long_enough_and_read_as_ecmascript():
    assert index_words("ab") == []
    assert index_words(r"\abcd") == []
    assert sorted(index_words("(?:curl|wget) http")) == [" http"]
    assert index_words("x*") == []


def test_twenty_thousand_rules_add_nothing_to_the_plan(corpus):
    def plan(n):
        found = static_findings(docs, [*low([rf"\bword{i}\b" for i in range(n)]), {"id": "C", "type": "ast", "severity": "low", "selector": "call:run"}])
        return found, found._jdf.queryExecution().executedPlan()

    docs = corpus(a_js="word7 word19999\nWORD200 word20000 run(1)", b_txt="word")
    found, large = plan(20_000)
    assert sorted((r.rule_id, r.line) for r in found.collect()) == [("C", 2), ("R19999", 1), ("R200", 2), ("R7", 1)]
    assert large.toString().count("RLIKE") == plan(300)[1].toString().count("RLIKE")
    with pytest.raises(ValueError, match="R250"):
        scan_regex(docs, low(["ok"] * 250 + ["(abc"]))


def test_patterns_that_are_a_word():
    assert literal_word(r"\bFoo_1\b") == ("foo_1", True, True)
    assert literal_word(r"foo\b") == ("foo", False, True)
    assert literal_word(r"a-B \. c\/d") == ("a-b . c/d", False, False)
    others = ["fo", "foo.", "fo|x", r"foo\d", r"\bfoo-bar\b", r"\b-foo", r"foo\b\b", r"a\bcd", "foo\n", "fooé", "foo{2}", "x{2}yy", "[foo]", "^foo", "foo$", r"f\x6fo", "foo?", r"foo\\n?", ""]
    assert [p for p in others if literal_word(p)] == []


def test_words_a_look_around_needs():
    assert required_words("(?<=of )o") == ["of o"]
    assert required_words(r"x*(?=abc)\w") == ["abc"]
    assert required_words("(?<=ab)(?:cd|ef)") == ["abcd", "abef"]
    assert required_words("(?<=abc|de)f?") == ["abc", "de"]
    assert required_words("(?<!abc)d(?!efg)") == ["d"]


def test_a_pack_of_words_finds_what_each_rule_finds_alone(spark):
    dice = random.Random(4)
    words = ["".join(dice.choices("aB_1", k=dice.choice([2, 3, 3, 4]))) for _ in range(220)]
    patterns = [dice.choice(["", r"\b"]) + w + dice.choice(["", r"\b"]) for w in words]
    patterns += ["a a", "a-b", r"a\.b", r"\ba-b\b", r"(?<=ab)a", "(?=aba)a", "(?<=a )b", r"aab\n?", "aé", r"\babé", "ſab", "aaK"]
    texts = ["".join(dice.choices("aAbB_1 -.\nésſK\r", weights=[6, 2, 6, 2, 2, 3, 6, 1, 1, 2, 1, 1, 1, 1, 1], k=200)) for _ in range(30)]
    docs = spark.createDataFrame([(f"{i}.txt", t) for i, t in enumerate([*texts, None, ""])], "path string, content string")
    tests = [F.expr(rule_matches(r)).alias(r["id"]) for r in low(patterns)]
    rows = explode_lines(docs).selectExpr("path", "line_no", "line AS text").select("path", "line_no", *tests).collect()
    alone = sorted((r.path, r.line_no, f"R{i}") for r in rows for i in range(len(patterns)) if r[f"R{i}"])
    assert sorted((r.path, r.line, r.rule_id) for r in scan_regex(docs, low(patterns)).collect()) == alone
    calls = [{"id": "C", "type": "ast", "severity": "low", "selector": "call:run"}]
    assert sorted((r.path, r.line, r.rule_id) for r in static_findings(docs, [*low(patterns), *calls]).collect()) == alone


def test_words_of_a_pack_are_not_tried_again(corpus):
    found = scan_regex(corpus(a_js="word7 aword8 a1b"), low([*[rf"\bword{i}\b" for i in range(300)], r"a\db"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "(?i)" not in plan.replace("(?i)a\\db", "")
    assert sorted(r.rule_id for r in found.collect()) == ["R300", "R7"]


@pytest.mark.parametrize("calls", [[], [{"id": "C", "type": "ast", "severity": "low", "selector": "call:run"}]])
def test_markers_in_a_large_pack(corpus, calls):
    docs = corpus(a_js="word1 word2 run(1)\nword1 word2 run(1) // Scan-Ignore\nword1 word2 run(1) // scan-ignore:r1\nword2 word1 // mute:R2 scan-ignored", b_js="// mute word2")
    rules = [*low([rf"\bword{i}\b" for i in range(300)]), *calls]
    got = sorted((r.path, r.line, r.rule_id) for r in static_findings(docs, rules).collect())
    c = [("a.js", 1, "C")] if calls else []
    assert got == [*c, ("a.js", 1, "R1"), ("a.js", 1, "R2"), *([("a.js", 3, "C")] if calls else []), ("a.js", 3, "R2"), ("b.js", 1, "R2")]
    muted = sorted((r.path, r.line, r.rule_id) for r in static_findings(docs, rules, "mute").collect() if r.rule_id != "C")
    assert muted == [("a.js", n, r) for n in (1, 2, 3) for r in ("R1", "R2")] + [("a.js", 4, "R1")]
