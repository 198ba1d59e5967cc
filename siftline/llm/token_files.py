"""Token ids of a corpus in files of Re-Pair grammars.

1. Texts are encoded once, and the ids are written next to the document's id, two
   bytes each where the vocabulary allows.
2. Rows are dealt out by ranges of ``doc_id`` (ties by the ids' checksum and by
   the row, so that a document repeated very often is spread as well) and sorted.
3. Each partition cuts its documents into shards of about ``shard_ids`` ids and
   replaces frequent pairs of each shard by rules (``grammar``).

The files are Parquet, one row a shard, written and committed by Spark, so lost tasks
leave nothing behind and any store that Spark reaches will do:

  part, shard        place of the shard: by part, then by shard
  first              number of ids before it in its part
  doc_ids            ids of its documents, in order
  n_ids              number of ids of each document
  n_symbols          number of symbols of each document
  vocabulary         symbols from here on are rules
  left, right, length   the two sides of each rule, and the ids it expands to
  symbols            the sequence

The last five arrays are little-endian unsigned numbers of 4 bytes (``symbols`` and
both sides of 2, if ``vocabulary`` and rules have room in them).

Cases: null texts are empty; a document without ids has its end id alone.  Null ids
come first.  Repeated rows are documents of their own.  A very long text is one
document of one shard, which then is longer than ``shard_ids``.  An empty table gives
no shards.  Extra columns are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.grammar import Grammar, compress, expand, ids_between
from siftline.plans.materialize import store

MEMO = 600_000  # words, and pieces of words, kept per task; changes speed, not results
MEMO_CHARS = 60  # longer words are not kept
SLICE = 32 << 20  # bytes of text whose different words are looked up together
WORDS = 1 << 17  # words whose ids are laid out at once
BLANKS = " \t\n\x0b\x0c\r"
LARGEST_TOKENIZER = 64 << 20  # bytes of a tokenizer file; it is sent to all tasks

SHARD = (
    "part int, shard int, first long, doc_ids array<long>, n_ids array<long>, n_symbols array<long>, vocabulary int, "
    "left binary, right binary, length binary, symbols binary"
)
DOCUMENT = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


# What a tokenizer does before its merges if it treats the words of a text on their own
WORDS_APART = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
# lower-case letters, digits and signs whose pieces the pattern above gives as they stand; no apostrophe
PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff0-9!-&(-/:-@\[-`{-~]+")
SHAPE = re.compile(r"([!-&(-/:-@\[-`{-~]*)([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")  # of most words
PIECE = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def byte_letters() -> list[str]:
    """The character that byte-level models put for each byte: itself if it is printable, else the next free one."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class TextIds:
    """Texts to their ids.

    A tokenizer that has the steps of ``WORDS_APART`` gives the words between ASCII
    white space the same ids wherever they stand.  Words of plain letters, digits and
    signs go to its merges piece by piece, others through all of it, and what it gave
    is kept.  Any other tokenizer gets whole texts.
    """

    def __init__(self, tokenizer_json: str, dtype: str):
        from tokenizers import Tokenizer

        steps = json.loads(tokenizer_json)
        self.tokenizer, self.dtype = Tokenizer.from_str(tokenizer_json), dtype
        merges = steps["model"]
        self.apart = all(steps[k] == v for k, v in WORDS_APART.items()) and merges["type"] == "BPE" and not merges["dropout"]
        # strings of added tokens are found before all else; these have no blanks, and plain words none of their starts
        starts = {t["content"][:2] for t in steps["added_tokens"]}
        self.apart = self.apart and starts <= {"<|"} and not any(set(t["content"]) & set(BLANKS) for t in steps["added_tokens"])
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.one = [self._bytes([i]) for i in range(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)]
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _through(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(c.ids) for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = [t.id for t in self.model.tokenize(letters)]
            found = self.one[ids[0]] if len(ids) == 1 else self._bytes(ids)
            if len(piece) <= MEMO_CHARS:
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        found = [*map(self.words.get, words)]
        others, piece, pieces = [], self._piece, self.pieces
        for i in [i for i, x in enumerate(found) if x is None]:
            lowered = words[i].lower()
            if lowered.isascii() and lowered.isalpha():
                found[i] = pieces.get(lowered) or piece(lowered)
            elif "<|" in lowered:
                others.append(i)
            elif shape := SHAPE.fullmatch(lowered):
                found[i] = b"".join([piece(x) for x in shape.groups() if x])
            elif PLAIN.fullmatch(lowered):
                found[i] = b"".join(map(piece, PIECE.findall(lowered)))
            else:
                others.append(i)
        for i, ids in zip(others, self._through([words[i] for i in others]), strict=True):
            found[i] = ids
        if len(self.words) + len(words) > MEMO:
            self.words.clear()
        self.words.update((w, x) for w, x in zip(words, found, strict=True) if len(w) <= MEMO_CHARS)
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end_id``, and how many each text has."""
        texts = texts.fill_null("")
        if self.apart:
            split = pc.ascii_split_whitespace(texts)
            coded = split.flatten().dictionary_encode()
            found, at, per_text = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy(), split.value_lengths().to_numpy()
        else:
            found, at, per_text = self._through(texts.to_pylist()), np.arange(len(texts)), np.ones(len(texts), np.int64)
        ids = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        begin, n = (np.cumsum(sizes) - sizes)[at], sizes[at]
        upto = np.append(0, np.cumsum(n))
        ends = upto[np.cumsum(per_text)] + np.arange(len(per_text))
        out = np.empty(int(upto[-1]) + len(per_text), ids.dtype)
        out[ends] = end_id
        rest = np.ones(len(out), bool)
        rest[ends] = False
        laid = np.empty(int(upto[-1]), ids.dtype)
        for a in range(0, len(at), WORDS):
            b = min(a + WORDS, len(at))
            laid[upto[a] : upto[b]] = ids[np.repeat(begin[a:b] - upto[a:b], n[a:b]) + np.arange(upto[a], upto[b])]
        out[rest] = laid
        return out, np.diff(np.append(-1, ends))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs (first, how many) of texts of at most ``SLICE`` bytes, or of one text."""
    upto = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()))
    first = 0
    while first < len(texts):
        past = max(int(np.searchsorted(upto, upto[first] + SLICE, "right")) - 1, first + 1)
        yield first, past - first
        first = past


def load_tokenizer(spark: SparkSession, path: str) -> tuple[str, int]:
    """The tokenizer file as text, read where Spark reads files, and the size of its vocabulary."""
    from tokenizers import Tokenizer

    file = spark.read.format("binaryFile").load(path).select("length", "content").first()
    if file["length"] > LARGEST_TOKENIZER:
        raise ValueError(f"{path} has {file['length']} bytes; a tokenizer may have {LARGEST_TOKENIZER}")
    text = bytes(file["content"]).decode()
    return text, max(Tokenizer.from_str(text).get_vocab(with_added_tokens=True).values()) + 1


def width(symbols: int) -> str:
    return "<u2" if symbols <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer_json: str, vocabulary: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_id, n, ids): all ids of each document with its end id, in ``width(vocabulary)``."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # bounded by LARGEST_TOKENIZER
    dtype = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo = TextIds(shared.value, dtype)
        for batch in batches:
            for at, rows in slices(batch.column("text")):
                part = batch.slice(at, rows)
                ids, counts = memo.encode(part.column("text"), end_id)
                places = np.append(0, np.cumsum(counts)) * ids.itemsize
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(ids)])
                columns = [part.column("doc_id"), part.column("row_id"), pa.array(counts, pa.int64()), cells.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_id", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_id long, n long, ids binary")


def shards(rows: DataFrame, vocabulary: int, shard_ids: int, least: int) -> DataFrame:
    """One row a shard, from sorted partitions of (part, doc_id, n, ids)."""
    dtype = width(vocabulary)

    def row(part: int, number: int, first: int, doc_ids: list, held: list[bytes]) -> pa.RecordBatch:
        counts = np.array([len(x) for x in held], np.int64) // np.dtype(dtype).itemsize
        ids, ends = np.frombuffer(b"".join(held), dtype), np.zeros(int(counts.sum()), bool)
        ends[np.cumsum(counts) - 1] = True
        found = compress(ids, ends, vocabulary, least)
        symbols = np.diff(np.append(0, np.flatnonzero(found.ends) + 1))
        thin = width(vocabulary + len(found.left))
        arrays = found.left.astype(thin), found.right.astype(thin), found.length.astype("<u4"), found.symbols.astype(thin)
        cells = [part, number, first, doc_ids, counts, symbols, vocabulary, *(x.tobytes() for x in arrays)]
        lists = pa.list_(pa.int64())
        types = [pa.int32(), pa.int32(), pa.int64(), lists, lists, lists, pa.int32(), *[pa.binary()] * 4]
        names = [c.split()[0] for c in SHARD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first, waiting, doc_ids, held = 0, 0, 0, 0, [], []
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for doc_id, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                if held and waiting + n > shard_ids:
                    yield row(part, number, first, doc_ids, held)
                    number, first, waiting, doc_ids, held = number + 1, first + waiting, 0, [], []
                waiting += n
                doc_ids.append(doc_id)
                held.append(ids)
        if held:
            yield row(part, number, first, doc_ids, held)

    return rows.mapInArrow(run, SHARD)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    shard_ids: int = 1 << 20,
    part_ids: int = 1 << 22,
    least: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The shards of a corpus in ascending order of ids, as written and read again.

    Parts hold about ``part_ids`` ids.  Pairs that occur ``least`` times in a shard
    become rules.
    """
    spark = docs.sparkSession
    tokenizer_json, vocabulary = load_tokenizer(spark, tokenizer_path)
    if not 0 <= end_id < vocabulary:
        raise ValueError(f"end id {end_id} is not one of the {vocabulary} ids")
    rows = store(encoded(docs, tokenizer_json, vocabulary, end_id, id_col, text_col), "token-ids")
    parts = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // part_ids))
    order = ["doc_id", "mark", "row_id"]
    dealt = rows.withColumn("mark", F.crc32("ids")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "n", "ids")
    return store(shards(dealt, vocabulary, shard_ids, least), "token-files")


def grammar_of(row: dict) -> Grammar:
    """The grammar of a shard's row."""
    vocabulary, counts = row["vocabulary"], np.array(row["n_symbols"], np.int64)
    length = np.frombuffer(row["length"], "<u4").astype(np.int64)
    thin = width(vocabulary + len(length))
    left, right, symbols = (np.frombuffer(row[c], thin).astype(np.int64) for c in ("left", "right", "symbols"))
    ends = np.zeros(len(symbols), bool)
    ends[np.cumsum(counts) - 1] = True
    return Grammar(vocabulary, left, right, length, symbols, ends)


def ids_of(row: dict, document: int, first: int = 0, past: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``past`` of a shard's document, by its place in the shard; nothing else is decoded."""
    counts = row["n_ids"]
    start, n = sum(counts[:document]), counts[document]
    past = n if past is None else min(past, n)
    return ids_between(grammar_of(row), start + max(0, min(first, n)), start + past)


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the shards.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the checksum
    of its ids as little-endian numbers of 4 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grammar = grammar_of(row)
                ids = expand(grammar, grammar.symbols).astype("<u4")
                past = np.cumsum(np.array(row["n_ids"], np.int64))
                starts = np.append(0, past[:-1])
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, past, strict=True)]
                cells = [[row["part"]] * len(sums), row["doc_ids"], row["first"] + starts, past - starts, sums]
                types = [pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=[c.split()[0] for c in DOCUMENT.split(", ")])

    found = files.mapInArrow(run, DOCUMENT)
    # one row a part, which holds ``part_ids`` ids
    sizes = files.groupBy("part").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, n: a + n)).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return found.join(base, "part").select("doc_id", (F.col("_base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
