"""SentencePiece encoding and decoding as a streaming Viterbi search.

Over the boundaries of the normalised text, each boundary keeps one backpointer: the piece that ends
there on its best path. Only boundaries within the longest piece's reach of the front can still be
continued, so the search keeps that window alone. Whenever the paths of all boundaries in the window
run through one common boundary, the ids before it are final: they are emitted and forgotten.

What "best" means is the model file's own rule:
- unigram files: the largest sum of piece scores; an unknown character costs the smallest score less 10.
- BPE files: the path that the merges would produce. A prefix's encoding is the only path whose
  neighbouring pieces all stay apart when merged by themselves, so a boundary takes the one piece that
  is stable beside the last piece of the path it extends. The ids equal those of the merge procedure.

Characters without a piece become their bytes' pieces (byte fallback) or the unknown id; no path
crosses them.

Defined results
- A null text gives null ids; an empty text gives no ids.
- ``exact`` says whether decoding gives the text back. It does for any text with byte fallback, unless
  the text holds U+2581 itself, which the model format cannot tell from a space.
- Very long texts need memory for their ids only; a stretch without word boundaries is streamed.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import documents

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6  # fixed values of the model format
_UNIGRAM, _BPE = 1, 2
_CACHED_WORDS = 400_000  # words per generation of a Python worker's cache
_CACHED_LENGTH = 48
_CACHED_PAIRS = 500_000  # neighbouring pieces whose merging is remembered


# --- the model file -------------------------------------------------------------------------------

def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at:at + size]
        at += size


class PieceModel:
    """Pieces, scores and normalisation of a model file given as bytes."""

    def __init__(self, data: bytes):
        import struct
        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.dummy_prefix, self.byte_fallback = _UNIGRAM, True, False
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind = trainer.get(3, _UNIGRAM)
                self.byte_fallback = bool(trainer.get(35, 0))
            elif number == 3:
                rules = dict(_fields(value))
                self.dummy_prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only models that leave the characters and spaces of a text as they are")
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (_NORMAL, _USER)}
        self._value = {p: self.scores[i] for p, i in self.ids.items()}
        self.bytes_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == _BYTE}
        self.unknown = self.types.index(_UNKNOWN)
        self.longest = max(map(len, self.ids), default=1)
        #: No piece spans the place before a word's space mark, so every path meets there.
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._unknown_score = min(self.scores[i] for i in self.ids.values()) - 10 if self.ids else 0.0
        self._apart = _Apart(self)
        #: What a path may consist of; in a BPE file the pieces that its merges can produce.
        self._steps = self.ids if self.kind == _UNIGRAM else {p: i for p, i in self.ids.items() if self._merge(p) == [p]}
        #: By every beginning of a piece, (length, id) of the pieces that end it, longest first.
        self._ways = {begin: tuple((n, self._steps[begin[-n:]]) for n in range(len(begin), 0, -1) if begin[-n:] in self._steps)
                      for begin in {piece[:i] for piece in self._steps for i in range(1, len(piece) + 1)}}
        self._words, self._tails = _WordCache(self, SPACE), _WordCache(self, "")
        #: The ids of a line's end, where paths meet before and after it.
        self._line = self._found("\n") if self.byte_fallback and "\n" not in self._steps else b""
        self._spelled = [bytes([int(p[3:5], 16)]) if t == _BYTE else b"" if t == _CONTROL else
                         p.replace(SPACE, " ").encode() if t != _UNKNOWN else " ⁇ ".encode()
                         for p, t in zip(self.pieces, self.types)]

    # --- encoding

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def _merge(self, text: str) -> list[str]:
        """The merge procedure itself, on a short string: the best-scored neighbours first, of equals the leftmost."""
        parts, value, never = list(text), self._value.get, float("-inf")
        worth = [value(a + b, never) for a, b in zip(parts, parts[1:])]
        while worth:
            best = max(worth)
            if best == never:
                break
            i = worth.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del worth[i]
            if i:
                worth[i - 1] = value(parts[i - 1] + parts[i], never)
            if i < len(worth):
                worth[i] = value(parts[i] + parts[i + 1], never)
        return parts

    def search(self, text: Iterable[str]) -> Iterator[int]:
        """Ids of a normalised text given as characters, emitted as soon as they are final."""
        steps, ways, apart, longest, pieces = self._steps, self._ways, self._apart, self.longest, len(self.pieces)
        bpe, values = self.kind == _BPE, self.scores
        end, held = 0, ""  # the characters since the last final boundary, the longest ending of the text that begins a piece
        # Per boundary of the window: where its best path's last piece begins, that piece's id times the pieces (-pieces: none),
        # the path's score. Each character is a piece, so every boundary has a path.
        begins, last, scores = [0], [-pieces], [0.0]

        def settle(boundary: int) -> list[int]:
            """The ids up to a boundary that all paths share; the search goes on from there."""
            nonlocal end, begins, last, scores
            found, at = [], boundary
            while at:
                found.append(last[at] // pieces)
                at = begins[at]
            end, last, scores = end - boundary, last[boundary:], scores[boundary:] or [0.0]
            begins = [0] + [x - boundary for x in begins[boundary + 1:]]
            return found[::-1]

        unknown_before = False
        for character in text:
            if character not in steps:  # nothing spans it: all paths meet before and after
                yield from settle(end)
                if self.byte_fallback:
                    yield from (self.bytes_ids[b] for b in character.encode())
                elif not unknown_before:
                    yield self.unknown
                unknown_before = True
                held, begins, last, scores = "", [0], [-pieces], [scores[0] + self._unknown_score]
                continue
            unknown_before = False
            held += character
            while (found := ways.get(held)) is None:
                held = held[1:]
            end += 1
            if bpe:
                for length, piece in found:
                    start = end - length
                    if start >= 0 and apart[last[start] + piece]:  # no other piece does
                        break
                begins.append(start)
                last.append(piece * pieces)
            else:
                best = -1
                for length, piece in found:
                    start = end - length
                    if start >= 0 and (best < 0 or scores[start] + values[piece] > top):  # of equal paths, the longer last piece
                        begin, best, top = start, piece, scores[start] + values[piece]
                begins.append(begin)
                last.append(best * pieces)
                scores.append(top)
            if end >= 2 * longest:
                meeting = self._meeting(begins, end)
                if meeting:
                    yield from settle(meeting)
        yield from settle(end)

    def _meeting(self, begins: list[int], end: int) -> int:
        """The last boundary that the paths of all boundaries still in reach have in common."""
        alive = set(range(end - self.longest + 1, end + 1))
        while len(alive) > 1:
            furthest = max(alive)
            alive.discard(furthest)
            alive.add(begins[furthest])
        return alive.pop()

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def encode_bytes(self, text: str) -> bytes:
        """The ids as 32-bit integers: a text's words are joined without touching every id."""
        if not self.words_apart or not self.dummy_prefix or not text:
            return self._found(self.normalise(text))
        words = text.split(" ")
        if "" in words or SPACE in text:  # runs of spaces are pieces of their own
            return b"".join(self._words[w[1:]] if w[0] == SPACE and SPACE not in w[1:] else self._found(w) for w in _words(self.normalise(text)))
        return b"".join(map(self._words.__getitem__, words))

    def _found(self, normal: str) -> bytes:
        return array("i", self.search(normal)).tobytes()

    # --- decoding

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self._spelled.__getitem__, ids)).decode("utf-8", errors="replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def _words(normal: str) -> Iterator[str]:
    """Cuts before a space mark that follows another character."""
    start = 0
    for i in range(1, len(normal)):
        if normal[i] == SPACE and normal[i - 1] != SPACE:
            yield normal[start:i]
            start = i
    yield normal[start:]


class _Apart(dict):
    """By left id * number of pieces + right id: whether two pieces stay apart when they are merged by themselves.
    Negative where there is nothing on the left."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, pair: int) -> bool:
        if pair < 0:
            return True
        if len(self) >= _CACHED_PAIRS:
            self.clear()
        both = [self.model.pieces[i] for i in divmod(pair, len(self.model.pieces))]
        found = self[pair] = self.model._merge("".join(both)) == both
        return found


class _WordCache(dict):
    """Ids (32-bit integers) by word, its ``mark`` left out; paths meet at its two ends, so the search needs to see each word once.
    Where they meet at the ends of lines too, what is between those is looked up by itself.

    Two generations: when the young one is full it becomes the old one, and words still in use move back.
    """

    def __init__(self, model: PieceModel, mark: str):
        super().__init__()
        self.model, self.mark, self.old = model, mark, {}

    def __missing__(self, word: str) -> bytes:
        if "\n" in word and self.model._line:
            first, *others = word.split("\n")
            return self.model._line.join([self[first], *map(self.model._tails.__getitem__, others)])
        found = self.old.get(word)
        if found is None:
            found = self.model._found(self.mark + word)
        if len(word) <= _CACHED_LENGTH:
            if len(self) >= _CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


@lru_cache(2)
def _model(data: bytes) -> PieceModel:
    return PieceModel(data)


# --- Spark ----------------------------------------------------------------------------------------

def _read(model_file: str) -> bytes:
    """The model file (under a megabyte) is read by the driver and travels with the tasks."""
    with open(model_file, "rb") as f:
        return f.read()


def encode_column(docs: DataFrame, model_file: str = MODEL_FILE, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of a text column as array<int> and ``<into>_exact``, the round trip's verdict."""
    data, at = _read(model_file), docs.columns.index(text)
    shape = T.StructType([*(f for f in docs.schema.fields if f.name not in (into, f"{into}_exact")),
                          T.StructField(into, T.ArrayType(T.IntegerType(), False)), T.StructField(f"{into}_exact", T.BooleanType())])
    keep = [i for i, name in enumerate(docs.columns) if name not in (into, f"{into}_exact")]

    def run(batches):
        model = _model(data)
        for batch in batches:
            found, exact = [], []
            for value in batch.column(at):
                value = value.as_py()
                found.append(b"" if value is None else model.encode_bytes(value))
                exact.append(None if value is None else model.decode(array("i", found[-1])) == value)
            ends = np.cumsum([0, *map(len, found)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)),
                                           pa.list_(pa.field("element", pa.int32(), False)), mask=pa.array([x is None for x in exact], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), ids, pa.array(exact, pa.bool_())],
                                             names=[f.name for f in shape.fields])

    return docs.mapInArrow(run, shape)


def decode_column(rows: DataFrame, model_file: str = MODEL_FILE, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the text of an id column."""
    data, at = _read(model_file), rows.columns.index(ids)
    keep = [i for i, name in enumerate(rows.columns) if name != into]
    shape = T.StructType([*(rows.schema.fields[i] for i in keep), T.StructField(into, T.StringType())])

    def run(batches):
        model = _model(data)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string())],
                                             names=[f.name for f in shape.fields])

    return rows.mapInArrow(run, shape)


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids, n_ids and whether decoding gives the text back, for every document."""
    return encode_column(documents(spark, folder).select("doc_id", "text")).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.col("ids_exact").alias("exact"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
SQL: dict[str, str] = {}
