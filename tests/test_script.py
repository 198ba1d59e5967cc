"""Call sites of script text."""

import time

import pytest

from siftline.functions.script import calls_in


@pytest.mark.parametrize(
    ("text", "callees"),
    [
        ("a.exec(x)", ["a.exec"]),
        ("a?.exec(x)", ["a?.exec"]),
        ("exec?.(x)", ["exec"]),
        ("a!.exec(x)", ["a!.exec"]),
        ("exec<string>(x)", ["exec"]),
        ("new exec(x)", []),
        ("new a.exec(x).run(y)", ["new a.exec(x).run"]),
        ("x = y\nnew exec(z)", []),
        ("new (exec(x))()", ["exec"]),
        ('log("exec(x)")', ["log"]),
        ("'it''s' + exec(1)", ["exec"]),
        ("don't exec(x)\nexec(y)", ["exec"]),
        ("// exec(x)\n/* exec(y) */ spawn(z)", ["spawn"]),
        ("`text ${exec(a)} text`", ["exec"]),
        ("`${`${exec(1)}`}` + spawn(2)", ["exec", "spawn"]),
        ("exec`x`", []),
        ("/exec(x)/.test(a)", ["/exec(x)/.test"]),
        ("a / exec(b) / c", ["exec"]),
        ("f(exec(g(x)))", ["f", "exec", "g"]),
        ("exec(1)(2)", ["exec(1)", "exec"]),
        ("a.b(c).exec(d)", ["a.b(c).exec", "a.b"]),
        ("function exec(a) { return spawn(b) }", ["spawn"]),
        ("class A { exec(x: string): void {} static async spawn() {} f = exec(1); }", ["exec"]),
        ("interface I { exec(x: string): void }", []),
        ("const o = { exec(x) { return 1 }, y: exec(2) }", ["exec"]),
        ("class C extends exec(x) { }", ["exec"]),
        ("if (exec(a)) { spawn(b) }", ["exec", "spawn"]),
        ("x = async (a) => exec(a)", ["exec"]),
        ("@exec(1) class B {}", ["exec"]),
        ("await exec(1)", ["exec"]),
        ("import('x')", ["import"]),
        ("(exec)(x)", ["(exec)"]),
        ("a. exec(1)", ["a. exec"]),
        ("exec(", ["exec"]),
        ("", []),
    ],
)
def test_callees_in_tree_order(text, callees):
    assert [c.callee for c in calls_in(text)] == callees


def test_a_chain_starts_where_its_first_name_stands(spark):
    from siftline.operators.calls import call_sites

    rows = [("a.ts", "x\n;\nfoo\n  .bar()\n  .exec(x)\n"), ("b.py", "exec(x)"), ("c.JS", "exec(x)"), ("d/.ts", "exec(x)")]
    sites = call_sites(spark.createDataFrame(rows, "path string, content string"), ["exec"]).collect()
    assert sorted((s.path, s.line_no, s.text) for s in sites) == [("a.ts", 3, "foo"), ("c.JS", 1, "exec(x)")]


def test_null_content_has_no_calls(spark):
    from siftline.operators.calls import call_sites

    assert call_sites(spark.createDataFrame([("a.ts", None)], "path string, content string")).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "exec(x)" + " " * 5000 + "y",
        "exec(x)\n" + "/" * 400 + "\ny",
        "exec(x) " + "/* c */ " * 400 + "y",
        "exec(x) " + "// " * 400,
        "exec" + "(" * 2000,
        "exec" + "<" * 2000 + "x",
        "/" * 3 + "exec(x)\n" + "a=/[" * 500,
    ],
    ids=["spaces", "slashes", "comments", "line comment", "open", "angles", "regex"],
)
def test_odd_texts_take_no_longer_than_plain_ones(text):
    import time

    start = time.perf_counter()
    calls_in(text)
    assert time.perf_counter() - start < 2


def test_long_chains_do_not_copy_their_callees():
    calls = calls_in("a" + ".b()" * 20_000 + ".exec(x)")
    assert len(calls) == 20_001
    assert calls[0].ends_in(".exec")
    assert calls[-1].callee == "a.b"


@pytest.mark.parametrize(
    ("text", "callees"),
    [
        ("type A = { exec(cmd: string): Promise<void> }", []),
        ("const o = { exec(cmd: string): void { run(cmd) } }", ["run"]),
        ("if (x) exec(y)\n{ f() }", ["exec", "f"]),
        ("const f = exec(x)\n{ g() }", ["exec", "g"]),
        ("class A { exec(a) { b() } run(a): void {} }", ["b"]),
        ("a ? exec(x) : y", ["exec"]),
        ("async (x) => { exec(x) }", ["exec"]),
        ("foo<Bar>(x); a < b; exec(y)", ["foo", "exec"]),
    ],
)
def test_calls_and_signatures_by_place(text, callees):
    assert [c.callee for c in calls_in(text)] == callees


def test_time_grows_with_the_text():
    took = []
    for n in (25_000, 250_000):
        start = time.process_time()
        assert [c.callee for c in calls_in("a<b " * n + "eval(x)")][-1:] == ["eval"]
        took.append(time.process_time() - start)
    assert took[1] < 30 * max(took[0], 0.05)
