"""Scanning files as they arrive."""

import time

import pytest
from pyspark.errors import StreamingQueryException

from siftline import catalogue as C
from siftline.operators.findings import static_findings
from siftline.sources.baseline import signatures
from siftline.sources.corpus import read_corpus
from siftline.streaming.watch import read_corpus_stream, watch


def test_watching_a_directory(spark, tmp_path):
    inbox = tmp_path / "inbox"
    (inbox / "sub").mkdir(parents=True)
    (inbox / "old.js").write_text("eval(1)")
    baseline = signatures(static_findings(read_corpus(spark, str(inbox)), C.BUILTIN_RULES))
    baseline.write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))

    def run():
        files = read_corpus_stream(spark, str(inbox), max_files=1)
        watch(files, C.BUILTIN_RULES, str(tmp_path / "found"), str(tmp_path / "state"), known).awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "found")).collect()
        return sorted((r.path, r.line, r.rule_id) for r in rows)

    (inbox / "sub/new.js").write_text("x\neval(2)")
    (inbox / "sub/notes.md").write_text("eval(2)")
    first = [("sub/new.js", 2, "SEC-001"), ("sub/new.js", 2, "SEC-101")]
    assert run() == first
    (inbox / "late.py").write_text("verify=False")
    assert run() == [("late.py", 1, "SEC-212"), *first]


def test_a_watch_reads_files_spark_passes_over(spark, tmp_path):
    inbox = tmp_path / "inbox"
    (inbox / "_pack").mkdir(parents=True)
    (inbox / "a.js").write_text("eval(1)")
    (inbox / "__init__.py").write_text("verify=False")
    (inbox / "_pack/b.js").write_text("x\neval(2)")
    (inbox / "_late.js").write_text("")
    (inbox / ".hidden.js").write_text("eval(3)")

    def run():
        files = read_corpus_stream(spark, str(inbox))
        watch(files, C.BUILTIN_RULES, str(tmp_path / "found"), str(tmp_path / "state")).awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "found")).collect()
        return sorted((r.path, r.line, r.rule_id) for r in rows)

    first = [("__init__.py", 1, "SEC-212"), ("_pack/b.js", 2, "SEC-001"), ("_pack/b.js", 2, "SEC-101")]
    first += [("a.js", 1, "SEC-001"), ("a.js", 1, "SEC-101")]
    assert run() == first
    (inbox / "_late.js").write_text("eval(4)")  # nothing that Spark lists is new
    assert run() == sorted([*first, ("_late.js", 1, "SEC-001"), ("_late.js", 1, "SEC-101")])
    assert run() == sorted([*first, ("_late.js", 1, "SEC-001"), ("_late.js", 1, "SEC-101")])


def test_a_watch_that_goes_on_lists_again(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    files = read_corpus_stream(spark, str(inbox))
    query = watch(
        files, C.BUILTIN_RULES, str(tmp_path / "found"), str(tmp_path / "state"), relist_seconds=0.5, processingTime="0 seconds"
    )
    try:
        (inbox / "_app.js").write_text("eval(1)")
        rows = []
        for _ in range(60):
            time.sleep(0.5)
            if list((tmp_path / "found").glob("*.parquet")):
                rows = spark.read.parquet(str(tmp_path / "found")).collect()
            if rows:
                break
        assert sorted((r.path, r.rule_id) for r in rows) == [("_app.js", "SEC-001"), ("_app.js", "SEC-101")]
    finally:
        query.stop()


def test_a_watch_fails_on_a_file_that_cannot_be_read(spark, tmp_path, monkeypatch):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "_long.js").write_text("x" * 60)
    monkeypatch.setattr("siftline.streaming.watch.MAX_BYTES", 50)
    files = read_corpus_stream(spark, str(inbox))
    query = watch(files, C.BUILTIN_RULES, str(tmp_path / "found"), str(tmp_path / "state"))
    with pytest.raises(StreamingQueryException, match="cannot read _long.js: too long"):
        query.awaitTermination(120)
