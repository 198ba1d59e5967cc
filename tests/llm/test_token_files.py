"""Grammars and token files: round trips, random access, and the tokenizer itself as the reference."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import token_files
from siftline.llm.grammar import compress, expand, ids_between
from siftline.llm.token_files import TextIds, ids_of, read_documents, write_token_files

FOLDER = "/opt/tokenizers"
WORDS, BYTES = f"{FOLDER}/word_bpe_49k.json", f"{FOLDER}/byte_bpe_50k.json"
needs_tokenizers = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the tokenizer files")

DOCUMENTS = st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=20)


@settings(max_examples=150, deadline=None)
@given(DOCUMENTS, st.integers(2, 4), st.sampled_from([4, 70_000]), st.data())
def test_grammar_gives_back_every_stretch(docs, least, vocabulary, data):
    ids, ends = np.array([x for d in docs for x in d]), np.array([i == len(d) - 1 for d in docs for i in range(len(d))])
    grammar = compress(ids, ends, vocabulary, least, 0.0)
    assert (expand(grammar, grammar.symbols) == ids).all()
    sizes = grammar.expanded(grammar.symbols)
    past = np.flatnonzero(grammar.ends) + 1
    assert np.cumsum(sizes)[past - 1].tolist() == np.cumsum([len(d) for d in docs]).tolist()
    first, last = sorted((data.draw(st.integers(0, len(ids))), data.draw(st.integers(0, len(ids) + 3))))
    assert (ids_between(grammar, first, last) == ids[first:last]).all()


def test_frequent_pairs_become_rules():
    ids = np.tile([5, 6, 7, 8], 4000)
    grammar = compress(ids, np.append(np.zeros(len(ids) - 1, bool), True), 10)
    assert len(grammar.symbols) < 20 and grammar.length.max() >= 1024
    assert (ids_between(grammar, 7001, 7009) == ids[7001:7009]).all()
    ones = compress(np.ones(4097, np.int64), np.append(np.zeros(4096, bool), True), 10)
    assert len(ones.symbols) < 20 and (expand(ones, ones.symbols) == 1).all() and ones.expanded(ones.symbols).sum() == 4097


LETTERS = ["a", "B", "the", " ", "\n", "é", "é", "́", "Å", "Å", "İ", "Σ", "ς", "'s", "'", "ẗ", "1", "२", "　", "\xa0", "\x1c", "\x85"]
LETTERS += ["😀", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "한", "ᄒ", "ᅡ", "#", "K", "Å", "ẞ", "ß", "Ö", "ÿ", "×", "ª", ".", "'LL", "ﬁ"]


@needs_tokenizers
@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_are_those_of_the_tokenizer(path):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        text = file.read()
    whole, ids = Tokenizer.from_str(text), TextIds(text, "<u2")
    assert ids.apart == (path == WORDS)
    random = np.random.default_rng(5)
    for size in (3, 8, 40):
        texts = ["".join(random.choice(LETTERS, random.integers(0, size))) for _ in range(600)]
        got, counts = ids.encode(pa.array([*texts, None], pa.string()), 1)
        want = [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts] + [[1]]
        assert [x.tolist() for x in np.split(got, np.cumsum(counts)[:-1])] == want


@needs_tokenizers
def test_full_memos_change_nothing(monkeypatch):
    with open(WORDS, encoding="utf-8") as file:
        text = file.read()
    texts = pa.array([" ".join(f"word{i}x, Näme{j}" for i in range(30)) for j in range(40)] + ["y" * 300, "é'" * 100])
    want = TextIds(text, "<u2").encode(texts, 1)
    monkeypatch.setattr(token_files, "MEMO", 7)
    monkeypatch.setattr(token_files, "WORDS", 5)
    ids = TextIds(text, "<u2")
    got = [ids.encode(texts.slice(i, 1), 1) for i in range(len(texts))]
    assert np.concatenate([x for x, _ in got]).tolist() == want[0].tolist() and [int(n[0]) for _, n in got] == want[1].tolist()


def reference(docs, path):
    """(doc_id, start, n_tokens, crc32) in the order of the files."""
    from tokenizers import Tokenizer

    whole, out, start = Tokenizer.from_file(path), [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@needs_tokenizers
@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_files_hold_every_id(spark, path):
    from tokenizers import Tokenizer

    long = "one long text of many words " * 3000
    texts = [None, "", "a b", "a b", long, "Zürich, naïve café's 12", "x " * 500]
    docs = [(37 * i % 101, texts[i % len(texts)]) for i in range(101)] + [(None, "no id")]
    rows = [(i, t, "clash", "clash") for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, row_id string").repartition(5)
    files = write_token_files(df, path, shard_ids=5000, part_ids=40_000)
    assert files.select("part").distinct().count() > 2 and files.count() > files.select("part").distinct().count()
    assert sorted(map(tuple, read_documents(files).collect()), key=str) == sorted(reference(docs, path), key=str)

    whole = Tokenizer.from_file(path)
    of = dict(docs)
    for row in files.collect():
        shard = row.asDict()
        for at in (0, len(shard["doc_ids"]) - 1):
            ids = whole.encode(of[shard["doc_ids"][at]] or "", add_special_tokens=False).ids + [1]
            assert ids_of(shard, at).tolist() == ids
            assert ids_of(shard, at, 3, 9).tolist() == ids[3:9] and ids_of(shard, at, -2, 2).tolist() == ids[:2]


@needs_tokenizers
def test_repeated_ids_and_empty_table(spark):
    docs = spark.range(500).selectExpr("7L as doc_id", "'same text' as text")
    found = read_documents(write_token_files(docs, WORDS, part_ids=300, shard_ids=100)).collect()
    assert sorted(r.start for r in found) == [3 * i for i in range(500)] and {r.n_tokens for r in found} == {3}
    assert read_documents(write_token_files(docs.limit(0), WORDS)).count() == 0
    with pytest.raises(ValueError):
        write_token_files(docs, WORDS, end_id=49_408)
