"""The registered queries against SQL, and the pipeline stage by stage."""

import os
import re

import pytest

import corpus_pipeline
from checks.compare import duck, rows_of
from siftline.llm.minhash import near_duplicates
from siftline.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@needs_tables
@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(spark, name):
    got, want = QUERIES[name](spark, SF_DIR).toPandas(), duck(SF_DIR).execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


@needs_tables
def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "personal_data", "mixing", "tokens"]

    scores = {r.doc_id: r.predicted for r in QUERIES["op6_toxicity"](spark, SF_DIR).collect()}
    kept = corpus_pipeline.store(stages["toxicity"](spark, docs, SF_DIR), "a")
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if not p}

    unique = corpus_pipeline.store(stages["near_duplicates"](spark, kept, SF_DIR), "b")
    groups = near_duplicates(kept).groupBy("component_id").count().count()
    assert unique.columns == COLUMNS and unique.count() == groups
    assert near_duplicates(unique).where("not kept").count() == 0

    masked = corpus_pipeline.store(stages["personal_data"](spark, unique, SF_DIR), "c")
    rows = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == COLUMNS and set(rows) == {r.doc_id for r in unique.collect()}
    for i, r in rows.items():
        assert not re.search(r"@mail\d", r.text)
        assert (r.text == before[i].text and r.n_chars == before[i].n_chars) or (re.search("<(EMAIL|IP|CARD|PHONE)>", r.text) and r.n_chars == len(r.text))

    mixed = corpus_pipeline.store(stages["mixing"](spark, masked, SF_DIR), "d")
    assert mixed.columns == COLUMNS and {r.doc_id for r in mixed.collect()} <= set(rows)
    tokens = stages["tokens"](spark, mixed, SF_DIR)
    assert tokens.count() == mixed.count() and tokens.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF_DIR).count() == mixed.count()


def test_stages_with_odd_rows(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c", "en", None, 5), (None, "a b c", "en", "s", 5), (4, "x@y.de", "en", "s", 6)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, None), (2, ""), (3, "a b c"), (4, "x@y.de")]
    masked = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.mask_personal_data(spark, kept, SF_DIR).collect()}
    assert masked == {1: (None, None), 2: ("", 0), 3: ("a b c", 5), 4: ("<EMAIL>", 7)}
    assert corpus_pipeline.mix(spark, docs, SF_DIR).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


HELPERS = ["_id", "_key", "_rows", "_spans", "_marks", "_plain", "_salt", "_copies", "_source", "copy", "mix_key", "score", "predicted"]
HELPERS += ["rest", "row", "text_key", "component_id", "kept", "mark", "label", "token_ids", "a.b"]


def test_stages_with_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in HELPERS)
    texts = ["write to x@y.de or so", "plain words here", "plain words here", None, "", "w " * 30_000]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), *(f"{c} {i}" for c in HELPERS)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (None, *rows[1][1:])], schema)
    extra = {r[0]: r[5:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF_DIR)
        assert got.columns == docs.columns, name
        for r in got.collect():
            assert r.doc_id is None or tuple(r)[5:] == extra[r.doc_id], name
            if name == "personal_data":
                assert not any("x@y.de" in str(x) for x in r)
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
    tokens = corpus_pipeline.tokenize(spark, docs, SF_DIR).collect()
    assert len(tokens) == len(texts) + 2 and all(r.round_trip for r in tokens)
    assert {r.n_tokens for r in tokens if r.doc_id == 3} == {None} and {r.n_tokens for r in tokens if r.doc_id == 4} == {0}


def test_toxic_stage_with_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3)], schema)
    kept = corpus_pipeline.drop_toxic(spark, docs, SF_DIR)
    assert kept.columns == docs.columns and kept.where("doc_id = 2").count() in (0, 2)
