"""Files, archives, rule packs, baselines and reply stores."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.operators.findings import diff_baseline, static_findings
from siftline.sources.archives import read_archive_files, read_archives
from siftline.sources.baseline import export_baseline_json, read_baseline, write_baseline
from siftline.sources.corpus import corpus_from_table, dedupe_paths, limit_files, path_filter, read_corpus, read_files
from siftline.sources.responses import append_responses, read_responses
from siftline.sources.rules import (
    MAX_RULES,
    apply_preset,
    builtin_rules,
    call_selectors,
    filter_rules,
    presets,
    read_rules,
    rejected_rules,
    rule_list,
    rules_from,
    rules_of,
    union_rules,
)


def ids(rules):
    return [r["id"] for r in rule_list(rules)]


@pytest.fixture
def tree(tmp_path):
    files = {
        "a.js": b"eval(1)",
        "sub/b.py": "é".encode(),
        "sub/bad.ts": b"ok \xff\xfe end",
        "sub/notes.md": b"text",
        "node_modules/x/c.js": b"eval(1)",
        "sub/test/d.js": b"eval(1)",
        "sub/with space.json": b"{}",
        ".hidden.js": b"eval(1)",
        "_under.js": b"eval(1)",
        "empty.js": b"",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_directory_scan(spark, tree):
    rows = {r.path: r.content for r in read_corpus(spark, str(tree)).collect()}
    assert rows == {
        "a.js": "eval(1)", "sub/b.py": "é", "sub/bad.ts": "ok �� end", "sub/with space.json": "{}",
        "_under.js": "eval(1)", "empty.js": "",
    }


def test_directory_scan_with_own_globs(spark, tree):
    rows = read_corpus(spark, str(tree), ["sub/**", "**/*.md"], ["**/*.json"]).collect()
    assert sorted(r.path for r in rows) == ["sub/b.py", "sub/bad.ts", "sub/notes.md", "sub/test/d.js"]
    assert read_corpus(spark, str(tree), include=None).filter("path = 'node_modules/x/c.js'").count() == 1


def test_single_file_is_read_whatever_its_name(spark, tree):
    rows = read_corpus(spark, str(tree / "sub/notes.md")).collect()
    assert [(r.path, r.content) for r in rows] == [(str(tree / "sub/notes.md"), "text")]


def test_missing_directory(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_corpus(spark, str(tmp_path / "none"))


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "pack.ZIP", "w") as z:
        z.writestr("x/a.js", "eval(1)")
        z.writestr("x/test/b.js", "eval(1)")
        z.writestr("c.py", b"\xff")
        z.writestr("d.md", "text")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    rows = {r.path: r.content for r in read_archives(spark, str(tmp_path)).collect()}
    assert rows == {"pack.ZIP!x/a.js": "eval(1)", "pack.ZIP!c.py": "�"}
    assert read_archives(spark, str(tmp_path), include=None).count() == 4


def test_table_as_corpus(spark):
    table = spark.createDataFrame([(1, "a", "x")], "id int, kind string, body string")
    row = corpus_from_table(table, F.concat_ws("/", "kind", "id"), "body").collect()[0]
    assert row.asDict() == {"path": "a/1", "content": "x"}


def test_path_filter_counts_a_path_once_and_dedupe(corpus):
    files = corpus(a_js="1", b_ts="2", c_md="3")
    both = path_filter(files, ["**/*.js", "a.*", "*.ts"], None)
    assert sorted(r.path for r in both.collect()) == ["a.js", "b.ts"]
    assert dedupe_paths(files.unionByName(both)).count() == 3
    assert path_filter(files, [], None).count() == 0


def test_limit_files_takes_the_first_paths_without_a_shuffle_of_contents(corpus):
    files = corpus(d_js="4", a_js="1", c_js="3", b_js="2")
    assert sorted(r.path for r in limit_files(files, 2).collect()) == ["a.js", "b.js"]
    assert limit_files(files, None) is files
    assert limit_files(files, 0) is files
    assert limit_files(files, 9).count() == 4


def test_builtin_rules_and_presets(spark):
    pack = builtin_rules(spark)
    assert pack.count() == 38
    assert {r.severity: r["count"] for r in pack.groupBy("severity").count().collect()} == {"critical": 4, "high": 21, "medium": 13}
    assert rules_of(pack, "regex").count() == 34
    assert [r.target for r in call_selectors(pack).orderBy("rule_ord").collect()] == ["eval", "exec", "execSync", "spawn"]
    kept = {p["name"]: apply_preset(pack, presets(spark), p["name"]).count() for p in C.PRESETS}
    assert kept == {"strict": 38, "balanced": 22, "development": 13, "ai-focused": 16, "owasp-only": 5}


def test_filter_rules(spark):
    pack = rules_from(spark, [{"id": "A", "group": "g"}, {"id": "B"}, {"id": "C", "group": "h"}])
    assert ids(filter_rules(pack)) == ["A", "B", "C"]
    assert ids(filter_rules(pack, [], [])) == ["A", "B", "C"]
    assert ids(filter_rules(pack, ["g", "h"], ["C"])) == ["A"]


def test_rule_directory_skips_only_broken_files(spark, tmp_path):
    rule = {"id": "CUSTOM-001", "name": "n", "description": "d", "severity": "low", "type": "regex", "pattern": "TODO",
            "fix": "f", "tags": ["custom"], "group": "custom"}
    (tmp_path / "b.json").write_text(json.dumps([rule, {**rule, "id": "CUSTOM-002"}], indent=2))
    (tmp_path / "a.json").write_text(json.dumps([{**rule, "id": "FIRST", "confidence": 0.5}]))
    (tmp_path / "object.json").write_text(json.dumps({**rule, "id": "NO"}))
    (tmp_path / "broken.json").write_text("[{")
    (tmp_path / "other.txt").write_text(json.dumps([{**rule, "id": "NO"}]))
    pack = read_rules(spark, str(tmp_path))
    assert ids(pack) == ["FIRST", "CUSTOM-001", "CUSTOM-002"]
    assert rule_list(pack)[1]["tags"] == ["custom"]
    (tmp_path / "mixed.json").write_text(json.dumps([{**rule, "id": "LAST"}, None]))
    got = {r.file.rsplit("/", 1)[-1]: r.reason for r in rejected_rules(spark, str(tmp_path)).collect()}
    assert got == {"object.json": "no JSON array", "broken.json": "not JSON", "mixed.json": "holds entries that are no rules"}
    assert rejected_rules(spark, str(tmp_path / "nowhere")).count() == 0
    assert ids(read_rules(spark, str(tmp_path / "b.json"))) == ["CUSTOM-001", "CUSTOM-002"]


def test_missing_and_empty_rule_places(spark, tmp_path):
    assert ids(read_rules(spark, str(tmp_path / "none"))) == []
    assert ids(read_rules(spark, str(tmp_path))) == []


def test_union_keeps_pack_order_and_repeated_ids(spark):
    first = rules_from(spark, [{"id": "B"}, {"id": "A"}])
    second = rules_from(spark, [{"id": "A"}])
    assert ids(union_rules(first, second)) == ["B", "A", "A"]


def test_rule_list_checks_the_size_of_a_pack(spark):
    assert MAX_RULES > 1
    with pytest.raises(ValueError, match="more than 1 rules"):
        rule_list(rules_from(spark, [{"id": "A"}, {"id": "B"}]), max_rules=1)


SIGNATURES = ["SEC-001|a.js|1|eval(1)", "X|b|0|"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (json.dumps(SIGNATURES), SIGNATURES),
        (json.dumps({"items": SIGNATURES}, indent=2), SIGNATURES),
        ("{", []),
        ("", []),
        ('{"other": 1}', []),
    ],
)
def test_baseline_json(spark, tmp_path, text, expected):
    place = tmp_path / "baseline.json"
    place.write_text(text)
    assert [r.signature for r in read_baseline(spark, str(place)).collect()] == expected


def test_baseline_with_lines_cut_off(spark, tmp_path):
    (tmp_path / "mixed.json").write_text('{"items":["a","b"]}\n["c"]\n\n{"items":["d","e\n{"items":["f"]}\n{"ite')
    (tmp_path / "indented.json").write_text('{\r\n  "items": [\r\n    "g",\r\n    "h"\r\n  ]\r\n}')
    (tmp_path / "broken.json").write_text('{"items":\n')
    (tmp_path / "name with space.json").write_text('[\n"i"\n]\n')
    found = read_baseline(spark, str(tmp_path)).collect()
    assert sorted(r.signature for r in found) == ["a", "b", "c", "f", "g", "h", "i"]


def test_missing_baseline_is_empty(spark, tmp_path):
    assert read_baseline(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("write", [write_baseline, export_baseline_json])
def test_baseline_round_trip(spark, corpus, tmp_path, write):
    findings = static_findings(corpus(a_js="eval(1)\neval('|')"), C.BUILTIN_RULES)
    left = write(findings, str(tmp_path / "known"))
    assert left is None or left.count() == 0
    known = read_baseline(spark, str(tmp_path / "known"))
    assert known.count() == 4
    assert diff_baseline(findings, known).count() == 0


def test_reply_store(spark, tmp_path):
    place = str(tmp_path / "store")
    assert read_responses(spark, place).count() == 0
    schema = "prompt_hash string, raw_text string, provider string, model string"
    append_responses(spark.createDataFrame([("k1", "old", "p", None), ("k2", None, "p", None)], schema), place)
    append_responses(spark.createDataFrame([("k1", "new", "p", "m")], schema), place)
    assert [tuple(r) for r in read_responses(spark, place).collect()] == [("k1", "new", "p", "m")]


@pytest.mark.parametrize("folder", [False, True])
@pytest.mark.parametrize(
    "text",
    [
        '["a", "b"]',
        '{"items": ["a", "b"]}',
        '{\n  "items": [\n    "a",\n    "b"\n  ]\n}\n',
        '[\n"a",\n"b"]',
        '["a"]\n\n["b"]\n',
        '{"items": ["a"]}\n{"items": ["b"]}\n',
    ],
)
def test_baseline_layouts(spark, tmp_path, folder, text):
    place = tmp_path / "known" if folder else tmp_path / "known file.json"
    if folder:
        place.mkdir()
        (place / "part one.json").write_text(text)
        (place / "two.json").write_text('{"items": ["c"]}')
    else:
        place.write_text(text)
    assert sorted(r.signature for r in read_baseline(spark, str(place)).collect()) == ["a", "b", *["c"] * folder]


def test_archives_name_what_cannot_be_read(spark, tmp_path):
    kinds = {"stored": zipfile.ZIP_STORED, "deflated": zipfile.ZIP_DEFLATED, "bz2": zipfile.ZIP_BZIP2, "lzma": zipfile.ZIP_LZMA}
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        for name, kind in kinds.items():
            z.writestr(f"{name}.py", f"{name} " * 100, compress_type=kind)
        z.writestr("empty.py", "")
        z.writestr("bad.py", "DAMAGED")
        z.writestr("locked.py", "LOCKED")
        z.writestr("left_out.xyz", "DAMAGED")
    blob = bytearray((tmp_path / "good.zip").read_bytes().replace(b"DAMAGED", b"damaged"))
    at = blob.rindex(b"locked.py") - 46  # its row in the central directory
    blob[at + 8] |= 1
    (tmp_path / "good.zip").write_bytes(blob)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "none.zip").write_bytes(b"")
    (tmp_path / "_over.zip").write_bytes(blob)
    files = read_archive_files(spark, str(tmp_path))
    assert {r.path: r.content for r in files.corpus.collect()} == {"good.zip!empty.py": "", **{f"good.zip!{k}.py": f"{k} " * 100 for k in kinds}}
    assert {r.path: r.reason for r in files.unread.collect()} == {
        "good.zip!bad.py": "damaged",
        "good.zip!locked.py": "encrypted",
        "broken.zip": "File is not a zip file",
        "none.zip": "empty",
        "_over.zip": "a name that Spark's reader passes over",
    }


def test_archives_of_one_name_stay_apart(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        with zipfile.ZipFile(tmp_path / name / "x.zip", "w") as archive:
            archive.writestr("m.py", name)
    rows = read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.content) for r in rows) == [("a/x.zip!m.py", "a"), ("b/x.zip!m.py", "b")]
    assert [r.path for r in read_archives(spark, str(tmp_path / "a" / "x.zip")).collect()] == ["x.zip!m.py"]


def test_every_file_is_read(spark, tmp_path):
    (tmp_path / "_private dir").mkdir()
    for name, text in (("__init__.py", "eval(x)"), ("_app.js", "eval(y)"), ("ok.py", "eval(z)"), ("empty.py", ""), ("_private dir/ä b.py", "é"), (".hidden.py", "no"), ("_long.py", "x" * 60), ("long.py", "y" * 60)):
        (tmp_path / name).write_text(text)
    (tmp_path / "_gone.py").symlink_to(tmp_path / "nowhere.py")
    files = read_files(spark, str(tmp_path), max_bytes=50)
    assert {r.path: r.content for r in files.corpus.collect()} == {
        "__init__.py": "eval(x)", "_app.js": "eval(y)", "ok.py": "eval(z)", "empty.py": "", "_private dir/ä b.py": "é",
    }
    assert {"_long.py", "long.py"} <= {r.path for r in files.unread.collect()}
    for name, text in (("__init__.py", "eval(x)"), ("empty.py", ""), ("ok.py", "eval(z)")):
        assert [r.content for r in read_corpus(spark, str(tmp_path / name)).collect()] == [text]


def test_a_file_that_goes_after_the_listing_is_unread(spark, tmp_path):
    (tmp_path / "_a.py").write_text("x")
    files = read_files(spark, str(tmp_path))
    (tmp_path / "_a.py").unlink()
    assert files.corpus.count() == 0
    assert [r.path for r in files.unread.collect()] == ["_a.py"]


def test_names_are_listed_in_the_tasks(spark, tmp_path, monkeypatch):
    from siftline.sources import corpus as module
    from siftline.sources.listing import _list, files_below

    for i in range(100):
        (tmp_path / ".git" / f"d{i}").mkdir(parents=True)
        for j in range(100):
            (tmp_path / ".git" / f"d{i}" / f"f{j}").touch()
    (tmp_path / "deep" / "er d%20ir").mkdir(parents=True)
    (tmp_path / "deep" / "er d%20ir" / "__init__.py").write_text("eval(x)")
    (tmp_path / "deep" / "ok.js").write_text("y")
    (tmp_path / "_a=b").mkdir()
    (tmp_path / "_a=b" / "c.js").write_text("z")

    def fail(*args):
        raise AssertionError("listed on the driver")

    monkeypatch.setattr(module, "all_files", fail)
    files = read_files(spark, str(tmp_path), ["**/*.js", "**/*.py"], ["**/.git/**"])
    assert {r.path: r.content for r in files.corpus.collect()} == {"deep/er d%20ir/__init__.py": "eval(x)", "deep/ok.js": "y", "_a=b/c.js": "z"}
    assert files.unread.count() == 0
    assert len(files.corpus._jdf.queryExecution().toString()) < 100_000
    assert files_below(spark, str(tmp_path)).count() == 10_003
    assert files_below(spark, str(tmp_path), ["**/.git/**"]).count() == 3

    import pyarrow as pa

    gone = pa.RecordBatch.from_pydict({"uri": [f"file:{tmp_path}/gone"], "path": ["gone"], "length": [0], "is_dir": [True]})
    assert [b.to_pylist() for b in _list(iter([gone]))] == [[{"uri": f"file:{tmp_path}/gone", "path": "gone", "length": 1, "is_dir": False}]]
