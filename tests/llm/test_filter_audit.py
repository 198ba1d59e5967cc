"""The byte transducer and the filter audit against plain Python."""

import re
from itertools import permutations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import transducer
from siftline.llm.filter_audit import FILTERS, filter_audit

DOCS = "doc_id long, text string, source string, words int, part string, mark string, copies string"
LABELS = "doc_id long, quality int, toxic int"


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)]


LETTERS = st.sampled_from(["a", "b", "ab", " ", "\n", "\x0b", "é", "A", "#", "|", "　", "😀", "\x1c"])
TEXTS = st.lists(st.one_of(st.none(), st.lists(LETTERS, max_size=60).map("".join)), max_size=20)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([4, 7, 64, transducer.BLOCK]))
def test_counts_agree_with_python(texts, block):
    whole, long = transducer.BLOCK, transducer.LONG
    transducer.BLOCK, transducer.LONG = block, 3 if block < 64 else long
    try:
        column = pa.array(["cut off", *texts], pa.string()).slice(1)
        assert transducer.count_texts(column).T.tolist() == [counts_of(t) for t in texts]
    finally:
        transducer.BLOCK, transducer.LONG = whole, long


def test_texts_longer_than_a_block():
    text = "Word " * 300_000 + "x" * 2_000_000 + " y"
    assert transducer.count_texts(pa.array([text, None, text[:10]])).T.tolist() == [[300_002, 3, 300_000, len(text), 0], [0] * 5, [2, 1, 2, 10, 0]]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(transducer, "NUMBERS", transducer.NUMBERS * 0)  # all words of a text collide
    text = " ".join(f"w{i % 50}" for i in range(400))
    assert transducer.count_texts(pa.array([text, "a b a"])).T.tolist() == [counts_of(text), counts_of("a b a")]


def audit(docs, labels):
    """Rows of the audit, by the definition."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for doc_id, text, source, *_ in docs:
        words, different, capitals, points, symbols = counts_of(text)
        fails = {"A": words < 200, "B": 100 * different < 50 * words, "C": 100 * capitals > 2 * points, "D": symbols > 0}
        others = [d[0] for d in docs if (d[1] or "") == (text or "") and d[0] is not None]
        fails["E"] = doc_id is not None and min(others) < doc_id
        rows.append((source or "", {f for f, x in fails.items() if x}, doc_id in good, doc_id in toxic))
    out, removed_in_all = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order):
                gone = [r for r in left if name in r[1]]
                redundant = sum(name in r[1] for r in mine) - len(gone)
                unique = sum(r[1] == {name} for r in mine)
                left = [r for r in left if name not in r[1]]
                removed_in_all[part, name] = removed_in_all.get((part, name), 0) + len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, removed_in_all[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_audit_agrees_with_the_definition(spark):
    long = " ".join(f"w{i}" for i in range(250))
    repeated = "same words " * 150
    texts = [long, long, repeated, "SHOUT", "", None, "a | b", long + " $", None, "x", long]
    docs = [(i, t, ["s", "t", None, ""][i % 4], 1, "clash", "clash", "clash") for i, t in enumerate(texts)]
    docs += [(None, long, "s", 1, None, None, None), (None, "x", "t", 1, None, None, None), (3, "SHOUT", None, 1, None, None, None)]
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (4, 1, 1), (None, 1, 1), (99, 1, 1), (5, None, 1)]
    got = found(filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    assert got == audit(docs, labels)
    assert len(got) == 3 * 120 * 5


def test_hot_text_and_empty_tables(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'one and the same' as text", "'s' as source")
    none = spark.createDataFrame([], LABELS)
    got = found(filter_audit(docs, none))
    assert got["s", "EABCD", 1][:3] == (1, 2999, 0) and got["s", "AEBCD", 2][:3] == (0, 0, 2999)
    assert filter_audit(docs.limit(0), none).count() == 0


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "A b", "s"), (2, "c", "s")], "doc_id long, text string, source string")
    got = found(filter_audit(docs, spark.createDataFrame([], LABELS), {"X": "words > 1", "Y": "capitals > 0"}))
    assert got == {("s", "XY", 1): (1, 1, 0, 0, 0, 0, 1), ("s", "XY", 2): (1, 0, 1, 0, 0, 0, 1), ("s", "YX", 1): (1, 1, 0, 0, 0, 0, 1), ("s", "YX", 2): (1, 0, 1, 0, 0, 0, 1)}
    with pytest.raises(ValueError):
        filter_audit(docs, docs, {"long name": "words > 1"})
    assert list(FILTERS) == list("ABCDE")
