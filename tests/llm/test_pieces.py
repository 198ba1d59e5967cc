"""Segmentation against every possible one, and the way back."""

import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm.pieces import MARK, Encoder, build, decode, encode, load
from siftline.llm.queries import MODEL

PIECES = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *((p, -s) for p, s in [
    (MARK, 3.0), ("a", 2.5), ("b", 2.75), ("c", 4.0), ("ab", 3.0), (f"{MARK}a", 2.25), (f"{MARK}ab", 7.0), ("abc", 6.5), ("bca", 5.0), ("ca", 3.5), ("é", 4.0), (MARK * 2, 5.0), ("cabab", 6.0),
])]


def model(extra=()):
    return build([*PIECES, *extra], list(range(1, 257)), 0, set(range(257)))


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text.encode()), np.int32).tolist()


def score_of(m, ids):
    values = dict(enumerate(s for _, s in PIECES))
    out, run = 0.0, b""
    for i in ids:  # the bytes of one character count as one unknown
        if 1 <= i <= 256:
            run += m.stands_for[i]
            if run.decode("utf-8", "ignore"):
                out, run = out + m.unknown_score, b""
        else:
            out += values[i]
    return out


def best(text, m):
    """Highest score over all ways to cut a marked text."""
    scores = {p: s for p, s in PIECES[257:]}
    top = -np.inf
    for cuts in itertools.product([0, 1], repeat=max(len(text) - 1, 0)):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        parts = [text[i:j] for i, j in itertools.pairwise(at)]
        if all(p in scores or len(p) == 1 for p in parts):
            top = max(top, sum(scores.get(p, m.unknown_score) for p in parts))
    return top


def test_best_segmentation():
    m, dice = model(), random.Random(4)
    encoder = Encoder(m)
    for _ in range(300):
        text = "".join(dice.choice("aabbcc  éx") for _ in range(dice.randrange(1, 9)))
        ids = ids_of(encoder, text)
        assert b"".join(m.stands_for[i] for i in ids).decode() == " " + text
        assert score_of(m, ids) == pytest.approx(best(MARK + text.replace(" ", MARK), m)), text


def test_pieces_across_spaces_need_the_whole_text():
    m = model([(f"a{MARK}b", -1.0)])
    assert not m.chunked
    assert ids_of(Encoder(m), "ca b")[-1] == len(PIECES)


def test_literal_marks_and_unknown_characters():
    m = model()
    for text in (MARK, f"a{MARK}b", f" {MARK} ", "😀", "", "a\x00b", "   ", "x" * 100_000):
        assert b"".join(m.stands_for[i] for i in ids_of(Encoder(m), text)).decode() == " " + text
    without = build([("<unk>", 0.0), (f"{MARK}a", -1.0)], None, 0, {0})
    assert ids_of(Encoder(without), "ab") == [1, 0]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the tokenizer file")
def test_round_trip(spark):
    m = load(spark, MODEL)
    assert m.chunked
    texts = ["", " ", "Hello  world\n", None, "漢字 ▁ naïve", "word " * 20_000, "z" * 30_000, "▁▁  ", "a" * 70 + " b"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, decoded string, n_tokens int")
    coded = docs.select("text", encode(F.col("text"), m).alias("ids")).select("text", "ids", decode(F.col("ids"), m).alias("back"))
    rows = coded.collect()
    assert [r.back for r in rows] == texts and rows[3].ids is None and rows[0].ids == []
    assert docs.limit(0).select(encode(F.col("text"), m)).count() == 0
    odd = spark.createDataFrame([([13, -5, 999_999, None, 1],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in odd.select(decode(F.col("ids"), m)).collect()] == [m.stands_for[13].decode(), None, ""]


def test_ids_and_texts_leave_the_worker_in_parts(spark, monkeypatch):
    class Plain:
        def __init__(self, run):
            self.run = run

        def asNondeterministic(self):
            return self.run

    texts = [None, "", "ab", "a abc é", " "] * 200
    monkeypatch.setattr(F, "arrow_udf", lambda kind: Plain)
    ids = list(encode(iter([pa.array(texts), pa.array([], pa.string())]), model()))
    assert max(map(len, ids)) <= 256 and sum(map(len, ids)) == len(texts)
    whole = pa.concat_arrays(ids)
    encoder = Encoder(model())
    assert whole.to_pylist() == [None if t is None else ids_of(encoder, t) for t in texts]
    back = list(decode(iter([whole]), model()))
    assert max(map(len, back)) <= 256
    assert pa.concat_arrays(back).to_pylist() == texts
