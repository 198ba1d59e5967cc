"""Mixing, sharding, repeated passages and toxicity on small tables."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm.mixing import mix_sources, source_rates
from siftline.llm.sharding import stratified_shards
from siftline.llm.suffixes import repeated_passages, shared_starts
from siftline.llm.toxicity import held_out, toxicity_scores

SCHEMA = "doc_id long, text string, lang string, source string, shard string, copy string, score string, spans string"


def rows(n=600):
    dice = random.Random(9)
    out = []
    for i in range(n):
        source = "hot" if i % 3 else dice.choice(["a", "b", "rare", None])
        out.append((i, None if i % 50 == 7 else " ".join(dice.choice("uvwxyzé") for _ in range(i % 40)), "en", source, "x", "y", "z", "w"))
    return [*out, out[5], out[5], (None, "no id", None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def test_shards_are_even_and_mixed(docs):
    got = stratified_shards(docs, shards=7).collect()
    assert len(got) == len(rows()) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    sizes = collections.Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    for source in ("hot", "a", "b", "rare", None):
        held = collections.Counter(r.shard for r in got if r.source == source)
        assert max(held.values()) - min(held[s] for s in range(7)) <= 2
    for r in got:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def test_shards_do_not_depend_on_buckets(docs):
    def key(r):
        return str((r.doc_id, r.shard, r.slot))

    few, many = (sorted(map(key, stratified_shards(docs, bucket_rows=n).collect())) for n in (10_000, 13))
    # rows of one id and text are interchangeable, so compare ids by place
    assert few == many
    assert stratified_shards(docs.limit(0)).count() == 0
    assert stratified_shards(docs.where("doc_id = 3"), shards=16).first().slot == 0


def test_many_small_sources_are_spread(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'t' as text", "if(id < 15000, concat('site', id), 'hot') as source")
    got = stratified_shards(docs, shards=10, bucket_rows=100)
    sizes = {(r.shard, r.source): r.n for r in got.selectExpr("shard", "if(source = 'hot', 'hot', 'site') as source").groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(sizes[s, "hot"] + sizes[s, "site"] == 2000 for s in range(10))
    assert all(abs(sizes[s, "hot"] - 500) <= 40 for s in range(10))
    assert got.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("top")).where("n = 2000 and top = 1999").count() == 10


def test_hot_sources_beyond_the_broadcast(docs, monkeypatch):
    from siftline.llm import mixing

    want = sorted(str((r.doc_id, r.source, r.copy, r.mix_key)) for r in mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "SMALL", 3)  # one source has more than a third of all rows
    assert sorted(str((r.doc_id, r.source, r.copy, r.mix_key)) for r in mix_sources(docs).collect()) == want


def test_learning_is_bounded_by_bytes(spark):
    from siftline.llm.toxicity import training_rows

    docs = spark.range(100).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 100) as text")
    labels = spark.range(100).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    for bytes_, least, most in ((1 << 20, 100, 100), (20_000, 30, 66), (0, 0, 0)):
        rows = training_rows(docs, labels, F.lit(True), 1000, bytes_, "doc_id", "text", "toxic").collect()
        assert least <= len(rows) <= most and sum(len(r.text) for r in rows) <= bytes_
    scored = toxicity_scores(docs.unionByName(spark.createDataFrame([(500, "w1 " * 300_000)], docs.schema)), labels)
    assert scored.where("doc_id = 500 and score between 0 and 1").count() == 1


def poisson_count(seed, name, rate):
    parts = max(1, math.ceil(rate / 256.0))
    total = 0
    for i in range(1, parts + 1):
        import hashlib

        u = int(hashlib.md5(f"{seed}|{name}|draw|{i}".encode()).hexdigest()[:12], 16) / 2**48
        part, mass, k = rate / parts, math.exp(-rate / parts), 0
        below = mass
        while below <= u and mass > 0:
            k += 1
            mass *= part / k
            below += mass
        total += k
    return total


def test_mixing_draws_poisson_counts(docs):
    weights = {"hot": 1.0, "a": 2.0, "b": 0.0}
    got = mix_sources(docs, weights, rest=0.5, size=3.0)
    assert got.columns == [*(c for c in docs.columns if c != "copy"), "copy", "mix_key"]
    out = got.collect()
    assert [r.mix_key for r in out] == sorted(r.mix_key for r in out) and not [r for r in out if r.source == "b"]
    rates = {r.source: r.rate for r in source_rates(docs, weights, 0.5, 3.0, "source").collect()}
    assert sum(rates[r[3]] for r in rows()) == pytest.approx(3.0 * len(rows()))
    counts = collections.Counter(r.doc_id for r in out)
    for row in rows()[:600]:
        if row[0] != 5:  # that one is in three rows
            assert counts[row[0]] == poisson_count(17, row[0], rates[row[3]])
    assert counts[5] == 3 * poisson_count(17, 5, rates[rows()[5][3]])
    assert mix_sources(docs.limit(0)).count() == 0


def test_large_rates_and_many_sources(spark, monkeypatch):
    from siftline.llm import mixing

    docs = spark.createDataFrame([(i, "t", "few" if i < 2 else "many") for i in range(2000)], "doc_id long, text string, source string")
    rate = 1000.0 / 2
    want = {i: poisson_count(17, i, rate) for i in (0, 1)}
    for small in (mixing.SMALL, 0):  # broadcast, and joined with salts
        monkeypatch.setattr(mixing, "SMALL", small)
        counts = dict(mix_sources(docs).where("source = 'few'").groupBy("doc_id").count().collect())
        assert counts == want and all(abs(n - rate) < 6 * rate**0.5 for n in counts.values())


def brute_passages(texts, least):
    words = [(t or "").encode().lower().split() for t in texts]
    held = collections.defaultdict(set)
    for i, w in enumerate(words):
        for j in range(len(w) - least + 1):
            held[tuple(w[j : j + least])].add(i)
    out = []
    for i, w in enumerate(words):
        spans = []
        for j in range(len(w) - least + 1):
            if len(held[tuple(w[j : j + least])]) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + least
                else:
                    spans.append([j, j + least])
        out.append([tuple(s) for s in spans])
    return out


def test_repeated_passages(spark):
    dice = random.Random(2)

    def prose(n):
        return " ".join(f"w{dice.randrange(5000)}" for _ in range(n))

    shared = [prose(n) for n in (49, 50, 51, 75, 130)]
    texts = [prose(dice.randrange(0, 80)) + " " + dice.choice(shared) + " " + prose(dice.randrange(0, 80)) for _ in range(60)]
    texts += [shared[4][i * 7 : 500] for i in range(5)] + [" ".join(shared), prose(300), shared[3] + " " + shared[3], shared[3].upper()]
    texts += ["tic toc " * 400, "tic toc " * 401, "alone again " * 300, None, "", "few words", "few words", texts[0], texts[0], prose(20_000) + " " + shared[2]]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, mark string, copies int")
    for least, anchor in ((50, 25), (20, 6)):
        got = {r.doc_id: [tuple(s) for s in r.spans] for r in repeated_passages(docs, least, anchor).collect()}
        assert [got[i] for i in range(len(texts))] == brute_passages(texts, least)
    nameless = spark.createDataFrame([(None, shared[4]), (None, shared[4] + " more"), (1, shared[4]), (1, shared[4])], "doc_id long, text string")
    assert {(r.doc_id, r.copies, tuple(map(tuple, r.spans))) for r in repeated_passages(nameless).collect()} == {(None, 1, ((0, 130),)), (None, 3, ((0, 130),)), (1, 3, ((0, 130),))}
    assert repeated_passages(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    dice = random.Random(6)
    bad = ["vile", "Rotten", "nasty"]
    docs, labels = [], []
    for i in range(800):
        words = [f"w{dice.randrange(400)}" for _ in range(dice.randrange(5, 200))]
        toxic = int(i % 5 == 0)
        if toxic:
            words.insert(dice.randrange(len(words)), dice.choice(bad) + ",")
        docs.append((i, " ".join(words), "en", "src", "a", "b", "c", "d"))
        if i % 10 < 7:
            labels.append((i, 1, toxic))
    docs += [(2000, "", *["x"] * 6), (2001, None, *["x"] * 6), (None, "vile", *["x"] * 6), docs[0]]
    labels += [(2000, 1, 0), (3, 1, None), (None, 1, 1), (99_999, 1, 1), (1, 1, 0)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    got = toxicity_scores(docs, labels, may_learn=~held_out()).select("doc_id", held_out().alias("held_out"), "score", "predicted").collect()
    assert len(got) == 804 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 800]
    wrong = [r for r in unseen if r.predicted != int(r.doc_id % 5 == 0)]
    assert len(unseen) > 100 and len(wrong) <= 0.03 * len(unseen)
    assert {r.predicted for r in got if r.doc_id in (2000, 2001)} == {0}


def test_toxicity_learns_only_where_it_may(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (
        {r.doc_id: r.score for r in toxicity_scores(docs, table, may_learn=~held_out()).collect()} for table in (labels, flipped)
    )
    assert first == second


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    assert {r.predicted for r in toxicity_scores(docs, labels.limit(0)).collect()} == {0}
    assert {r.predicted for r in toxicity_scores(docs, labels.where("toxic = 1")).collect()} == {1}
    assert toxicity_scores(docs.limit(0), labels).count() == 0


def test_starts_of_other_texts_are_neighbours_in_the_sort(spark):
    rng = np.random.default_rng(5)
    pairs = {(int(t), 7) for t in range(300)} | {(int(t), int(a)) for t, a in rng.integers(0, 900, (1500, 2))} | {(3, -(2**63)), (4, 2**63 - 1)}
    texts = {}
    for text, anchor in pairs:
        texts.setdefault(anchor, set()).add(text)
    expected = {(t, a) for t, a in pairs if len(texts[a]) > 1}
    rows = spark.createDataFrame(sorted(pairs), "text_id long, anchor long").repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for partitions, batch in ((1, 10_000), (37, 1), (37, 7), (400, 10_000)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = [(r.text_id, r.anchor) for r in shared_starts(rows).collect()]
            assert len(got) == len(set(got))
            assert set(got) == expected
        assert shared_starts(rows.limit(0)).count() == 0
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
