"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The pieces of a model are put into one automaton.  A text is read once; at each
character the output links give every piece that ends there, longest first, and
relax the best score of that position (Viterbi).  The result is the segmentation
of highest total score under the model's own piece scores; among equal ones the
longest last piece wins.  Characters without a piece become the bytes of their
UTF-8 form where the model has byte pieces, else the unknown id.

No piece spans from a word to the space after it, so a text falls into chunks of
spaces and a word that are segmented on their own; results for chunks seen before
come from a memo of bounded size.  Models with other pieces get the whole text as
one chunk.

Decoding gives back the very text: every space is a mark, one mark in front is
added and taken off again, and a mark that stands in the text itself is encoded
by its bytes.

Cases: null texts give null, empty texts no ids; very long texts and words are
encoded whole, in time linear in their length.  Ids outside the vocabulary and
control pieces decode to nothing, broken UTF-8 to the replacement character.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siftline.llm.shingles import ROWS, texts_of

MARK = "▁"
MEMO = 400_000  # chunks kept per task; changes speed, not results
MEMO_BYTES = 60  # longer chunks are not kept
LARGEST_MODEL = 64 << 20  # bytes of a model file; it is sent to all tasks
SHIFT = 21  # code points are below 2^21
UNKNOWN_BELOW = 10.0  # an unknown character scores this much less than the worst piece


@dataclass
class PieceModel:
    """The automaton over the pieces, and the bytes each id stands for."""

    go: dict[int, int]
    fail: list[int]
    link: list[int]
    piece: list[int]
    length: list[int]
    score: list[float]
    unknown_score: float
    unknown_id: int
    byte_ids: list[int] | None
    stands_for: list[bytes]
    missing: str
    chunked: bool


def build(pieces: list[tuple[str, float]], byte_ids: list[int] | None, unknown_id: int, silent: set[int]) -> PieceModel:
    """``pieces`` in order of their ids; ``silent`` ids (control, unknown, unused, bytes) are not matched."""
    go: dict[int, int] = {}
    length, piece, score, children = [0], [-1], [0.0], [[]]
    for number, (text, value) in enumerate(pieces):
        if number in silent or not text:
            continue
        node = 0
        for char in map(ord, text):
            following = go.get(node << SHIFT | char)
            if following is None:
                following = go[node << SHIFT | char] = len(length)
                children[node].append((char, following))
                children.append([])
                length.append(length[node] + 1)
                piece.append(-1)
                score.append(0.0)
            node = following
        piece[node], score[node] = number, value
    fail, link = [0] * len(length), [0] * len(length)
    waiting = deque(node for _, node in children[0])
    while waiting:
        node = waiting.popleft()
        link[node] = fail[node] if piece[fail[node]] >= 0 else link[fail[node]]
        for char, child in children[node]:
            at = fail[node]
            while at and go.get(at << SHIFT | char) is None:
                at = fail[at]
            found = go.get(at << SHIFT | char, 0)
            fail[child] = found if found != child else 0
            waiting.append(child)
    matched = [(t, s) for i, (t, s) in enumerate(pieces) if i not in silent]
    used = {char for text, _ in matched for char in text}
    stands_for = [b"" if i in silent else t.replace(MARK, " ").encode() for i, (t, _) in enumerate(pieces)]
    for value, number in enumerate(byte_ids or []):
        stands_for[number] = bytes([value])
    return PieceModel(
        go, fail, link, piece, length, score,
        unknown_score=min((s for _, s in matched), default=0.0) - UNKNOWN_BELOW,
        unknown_id=unknown_id,
        byte_ids=byte_ids,
        stands_for=stands_for,
        missing=next(chr(c) for c in range(0xE000, 0xF900) if chr(c) not in used),
        chunked=not any(MARK in text.lstrip(MARK) for text, _ in matched),
    )


def load(spark: SparkSession, path: str) -> PieceModel:
    """From a SentencePiece model file, read where Spark reads files."""
    import sentencepiece

    file = spark.read.format("binaryFile").load(path).select("length", "content").first()
    if file["length"] > LARGEST_MODEL:
        raise ValueError(f"{path} has {file['length']} bytes; a model may have {LARGEST_MODEL}")
    model = sentencepiece.SentencePieceProcessor(model_proto=bytes(file["content"]))
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in ids]
    silent = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
    named = {text: i for i, (text, _) in enumerate(pieces) if model.is_byte(i)}
    byte_ids = [named[f"<0x{b:02X}>"] for b in range(256)] if len(named) == 256 else None
    return build(pieces, byte_ids, model.unk_id(), silent)


def segment(model: PieceModel, text: str, plain: str) -> list[int]:
    """Ids of the best segmentation of a text with its marks in place; ``plain`` is the same without."""
    go, fail, link, piece, length, score = model.go, model.fail, model.link, model.piece, model.length, model.score
    best, steps, ids = [0.0], [0], [0]
    node = 0
    for i, char in enumerate(map(ord, text)):
        while True:
            following = go.get(node << SHIFT | char)
            if following is not None:
                node = following
                break
            if not node:
                break
            node = fail[node]
        top, step, number, single = -np.inf, 1, -1, False
        at = node if piece[node] >= 0 else link[node]
        while at:
            size = length[at]
            reached = best[i + 1 - size] + score[at]
            if reached > top:
                top, step, number = reached, size, piece[at]
            single = size == 1
            at = link[at]
        if not single and best[i] + model.unknown_score > top:
            top, step, number = best[i] + model.unknown_score, 1, -1
        best.append(top)
        steps.append(step)
        ids.append(number)
    out: list[int] = []
    i = len(text)
    while i:
        if ids[i] >= 0:
            out.append(ids[i])
        elif model.byte_ids is None:
            out.append(model.unknown_id)
        else:
            out.extend(model.byte_ids[b] for b in reversed(plain[i - 1].encode()))
        i -= steps[i]
    return out[::-1]


class Encoder(dict):
    """Chunks (a word, or a number of spaces and a word) to their ids as int32 bytes."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: bytes | tuple[int, bytes]) -> bytes:
        spaces, word = chunk if isinstance(chunk, tuple) else (1, chunk)
        plain = word.decode()
        marked = MARK * spaces + plain.replace(MARK, self.model.missing)
        value = np.array(segment(self.model, marked, " " * spaces + plain), np.int32).tobytes()
        if spaces + len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = value
        return value

    def encode(self, text: bytes) -> bytes:
        if not text:
            return b""
        if not self.model.chunked:
            return self._whole(text.decode())
        words = text.split(b" ")
        if b"" not in words:
            return b"".join(map(self.__getitem__, words))
        chunks: list = []
        spaces = 0
        for word in words:
            spaces += 1
            if word:
                chunks.append(word if spaces == 1 else (spaces, word))
                spaces = 0
        if spaces:
            chunks.append((spaces, b""))
        return b"".join(map(self.__getitem__, chunks))

    def _whole(self, text: str) -> bytes:
        marked = MARK + text.replace(MARK, self.model.missing).replace(" ", MARK)
        return np.array(segment(self.model, marked, " " + text), np.int32).tobytes()


def encode(text: Column, model: PieceModel) -> Column:
    """Ids of each text as ``array<int>``."""
    shared = SparkSession.active().sparkContext.broadcast(model)  # bounded by the size of the model file

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for texts in batches:
            encoded = (None if t is None else encoder.encode(t) for t in texts_of(texts))
            while found := list(islice(encoded, ROWS)):  # ids leave the worker as they come
                ends = np.cumsum([0, *(len(x or b"") // 4 for x in found)], dtype=np.int32)
                ids = np.frombuffer(b"".join(x or b"" for x in found), np.int32)
                yield pa.ListArray.from_arrays(ends, pa.array(ids), mask=pa.array([x is None for x in found]))

    return run.asNondeterministic()(text)


def decode(ids: Column, model: PieceModel) -> Column:
    """The text of each array of ids."""
    shared = SparkSession.active().sparkContext.broadcast(model.stands_for)

    def text_of(pieces: list[bytes], numbers: np.ndarray) -> str:
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= len(pieces)):
            numbers = numbers[(numbers >= 0) & (numbers < len(pieces))]
        data = b"".join(map(pieces.__getitem__, numbers.tolist()))
        return data.removeprefix(b" ").decode("utf-8", "replace")

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in (batch.slice(start, ROWS) for batch in batches for start in range(0, len(batch), ROWS)):
            flat = lists.flatten().fill_null(-1).to_numpy()  # without the values of null lists
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            starts, known = np.concatenate([[0], ends[:-1]]), lists.is_valid().to_pylist()
            yield pa.array([text_of(shared.value, flat[a:b]) if ok else None for a, b, ok in zip(starts, ends, known, strict=True)], pa.string())

    return run.asNondeterministic()(ids)
