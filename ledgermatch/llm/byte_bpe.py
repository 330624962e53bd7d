"""Byte-level BPE encoding and decoding with padded matrices of parts.

A text is split by the rank file's pattern; each match is merged by itself. The matches that a task has not
met yet are bucketed by length, and each bucket is one matrix: a row per match, a column per part, padded to
the bucket's longest. In each round every row merges its leftmost pair of the smallest rank: the ranks of all
neighbours stand in a second matrix, one ``argmin`` per row finds the pair, its left cell takes the merged
part, its right cell goes, and only the two pairs beside it are looked up again. Since every row loses exactly
one cell a round, the rest is again a matrix, one column narrower. Rows without a pair left leave it.

The lookup is an open-addressing hash table over (left part, right part) in numpy arrays: all pairs whose bytes
together are a part of the file. A match that is itself a part takes its id without merging, as the rank
files' own library does.

Long matches (over ``LONG`` bytes) are merged one at a time in one row. A round there merges the leftmost pair of the
smallest rank and, as the rounds after it would, its further occurrences up to the first whose merge puts a
pair of smaller rank beside it; that keeps the number of rounds near the number of different ranks.

Defined results
- A null text counts as empty; an empty text has no ids and decodes to no bytes.
- Special tokens' names in a text are ordinary text.
- Texts of any length are encoded whole: a long one is split piece by piece, and only its ids are held.
- Repeated rows and ids of any kind are rows of their own; other columns are kept as they are, one named like
  the result is replaced. An empty table gives an empty table.
- Decoding takes any ids of the file; null ids give null, an id that the file lacks aborts the task.
"""

from __future__ import annotations

import base64
import itertools
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import documents, whole_text

RANKS_NAME = "byte_bpe_multi_50k.tiktoken"
LONG = 256
_WIDTHS = (4, 6, 8, 12, 16, 24, 48, 96, LONG)  # buckets: a match is padded by a half at most
_MATRIX_CELLS = 1 << 20
_ROWS_AT_ONCE, _WORDS_AT_ONCE = 512, 50_000
_CACHED_WORDS, _CACHED_LENGTH = 100_000, 48
_NEVER = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> id of the two together, for whole arrays at once."""

    def __init__(self, ids: dict[bytes, int]):
        found = [(ids[part[:i]], ids[part[i:]], rank) for part, rank in ids.items()
                 for i in range(1, len(part)) if part[:i] in ids and part[i:] in ids]
        left, right, rank = (np.array(x, np.int64) for x in (zip(*found) if found else ((), (), ())))
        self.bits = max(4, (2 * len(found)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NEVER, np.int32)
        keys = left << 32 | right
        slots = self._slots(keys)
        while len(keys):  # of the pairs that want a free slot, the one that got it stays
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            placed = free & (self.keys[slots] == keys)
            self.ranks[slots[placed]] = rank[placed]
            keys, rank, slots = keys[~placed], rank[~placed], (slots[~placed] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, ``_NEVER`` where the two make no part; negative ids (padding) make none."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(keys.shape, _NEVER, np.int32)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        wanted, slots, flat = keys.ravel()[open_], self._slots(keys.ravel()[open_]), out.ravel()
        while len(open_):
            there = self.keys[slots]
            hit = there == wanted
            flat[open_[hit]] = self.ranks[slots[hit]]
            on = ~hit & (there != -1)
            open_, wanted, slots = open_[on], wanted[on], (slots[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(keys.shape)


def merge_matrix(parts: np.ndarray, pairs: PairTable) -> list[np.ndarray]:
    """The parts left of each row of ``parts`` (ids, padded with -1 at the end)."""
    out: list[np.ndarray | None] = [None] * len(parts)
    row_of = np.arange(len(parts))
    ranks = pairs.look_up(parts[:, :-1], parts[:, 1:])
    while len(parts):
        if parts.shape[1] > 1:
            at = ranks.argmin(1)  # the leftmost of the smallest
            rows = np.arange(len(parts))
            best = ranks[rows, at]
            ended = best == _NEVER
        else:
            ended = np.ones(len(parts), bool)
        for row, line in zip(row_of[ended].tolist(), parts[ended]):
            out[row] = line[line >= 0]
        if ended.all():
            break
        if ended.any():
            going = ~ended
            parts, ranks, row_of, at, best = parts[going], ranks[going], row_of[going], at[going], best[going]
            rows = np.arange(len(parts))
        width = parts.shape[1]
        parts[rows, at] = best
        kept = np.ones(parts.shape, bool)
        kept[rows, at + 1] = False
        parts = parts[kept].reshape(len(parts), width - 1)
        kept = np.ones(ranks.shape, bool)
        kept[rows, at] = False  # the merged pair; its neighbours' ranks are looked up anew
        ranks = ranks[kept].reshape(len(parts), width - 2)
        for beside in (-1, 0):
            has = np.flatnonzero((at + beside >= 0) & (at + beside < width - 2))
            column = at[has] + beside
            ranks[has, column] = pairs.look_up(parts[has, column], parts[has, column + 1])
    return out


def merge_long(parts: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The same for one long row: a round merges a pair's occurrences until a merge makes a pair of smaller rank."""
    ranks = pairs.look_up(parts[:-1], parts[1:])
    while len(parts) > 1:
        best = ranks.min()
        if best == _NEVER:
            break
        at = np.flatnonzero(ranks == best)
        # Of occurrences that overlap (a run of one part), every second one merges.
        chain = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1
        begin = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        at = at[(np.arange(len(at)) - begin[chain]) % 2 == 0]
        # What stands beside an occurrence when it is merged: the one before it may be merged already, the next not yet.
        before = np.where(at > 0, parts[np.maximum(at - 1, 0)], -1)
        before[1:][at[1:] - at[:-1] == 2] = best
        after = np.where(at + 2 < len(parts), parts[np.minimum(at + 2, len(parts) - 1)], -1)
        merged = np.full(len(at), best, parts.dtype)
        smaller = np.minimum(pairs.look_up(before, merged), pairs.look_up(merged, after)) < best
        if smaller.any():
            at = at[:int(smaller.argmax()) + 1]
        parts[at] = best
        kept = np.ones(len(parts), bool)
        kept[at + 1] = False
        parts, place = parts[kept], at - np.arange(len(at))
        ranks = ranks[kept[1:]] if len(parts) > 1 else ranks[:0]
        for column in (place - 1, place):
            column = column[(column >= 0) & (column < len(parts) - 1)]
            ranks[column] = pairs.look_up(parts[column], parts[column + 1])
    return parts


class ByteBpe:
    """Encoder and decoder of a rank file given as bytes, with the ids of the words met so far.

    The words are kept in two generations: when the young one is full it becomes the old one, and words still
    in use move back.
    """

    def __init__(self, ranks: bytes, pattern: str):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(256):
            self.byte_ids[i] = self.ids[bytes([i])]
        self.parts = [b""] * (max(self.ids.values()) + 1)
        for part, i in self.ids.items():
            self.parts[i] = part
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @cached_property
    def pairs(self) -> PairTable:
        return PairTable(self.ids)

    # --- encoding

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of matches given as bytes."""
        out = [b""] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self.ids.get(word)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(word) > LONG:
                out[i] = merge_long(self.byte_ids[np.frombuffer(word, np.uint8)], self.pairs).astype("<u4").tobytes()
            else:
                buckets.setdefault(next(w for w in _WIDTHS if len(word) <= w), []).append(i)
        for members in buckets.values():
            width = max(len(words[i]) for i in members)
            rows = max(1, _MATRIX_CELLS // width)
            for start in range(0, len(members), rows):
                chosen = members[start:start + rows]
                lengths = np.fromiter((len(words[i]) for i in chosen), np.int64, len(chosen))
                parts = np.full((len(chosen), width), -1, np.int32)
                parts[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(words[i] for i in chosen), np.uint8)]
                for i, left in zip(chosen, merge_matrix(parts, self.pairs)):
                    out[i] = left.astype("<u4").tobytes()
        return out

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of all ``words``. Short ones are remembered."""
        fresh, known = [], {}
        for word in set(words):
            found = self.young.get(word) or self.old.get(word)
            if found is None:
                fresh.append(word)
            else:
                known[word] = found
        known.update(zip(fresh, self.merged([w.encode() for w in fresh])))
        for word, found in known.items():
            if len(word) <= _CACHED_LENGTH and word not in self.young:
                if len(self.young) >= _CACHED_WORDS:
                    self.old, self.young = self.young, {}
                self.young[word] = found
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. Their matches are listed for ``_WORDS_AT_ONCE`` of them at a time."""
        out = [bytearray() for _ in texts]
        listed: list[tuple[int, list[str]]] = []
        held = 0

        def close() -> None:
            nonlocal held
            found = self.learn(itertools.chain.from_iterable(words for _, words in listed)).__getitem__
            for i, words in listed:
                out[i] += b"".join(map(found, words))
            listed.clear()
            held = 0

        for i, text in enumerate(texts):
            for words in self.split(text):
                listed.append((i, words))
                held += len(words)
                if held >= _WORDS_AT_ONCE:
                    close()
        close()
        return [bytes(x) for x in out]

    def split(self, text: str) -> Iterator[list[str]]:
        """The matches of a text, listed a part at a time if it is long."""
        if len(text) <= _WORDS_AT_ONCE:
            yield self.pattern.findall(text)
            return
        matches = (m.group() for m in self.pattern.finditer(text))
        while words := list(itertools.islice(matches, _WORDS_AT_ONCE)):
            yield words

    # --- decoding

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.parts.__getitem__, array("I", ids)))


@lru_cache(2)
def _tokenizer(ranks: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(ranks, pattern)


# --- Spark --------------------------------------------------------------------------------------------

def _files(ranks_file: str | None, pattern: str | None) -> tuple[bytes, str]:
    """The rank file (under a megabyte) is read by the driver and travels with the tasks."""
    if ranks_file is None or pattern is None:
        import public_tokenizers
        ranks_file, pattern = ranks_file or public_tokenizers.path(RANKS_NAME), pattern or public_tokenizers.PATTERN
    with open(ranks_file, "rb") as f:
        return f.read(), pattern


def _mapped(rows: DataFrame, column: str, into: str, files: tuple[bytes, str], convert) -> DataFrame:
    at, keep = rows.columns.index(column), [i for i, name in enumerate(rows.columns) if name != into]
    shape = T.StructType([*(rows.schema.fields[i] for i in keep), T.StructField(into, T.BinaryType())])

    def run(batches):
        tokenizer = _tokenizer(*files)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(start, _ROWS_AT_ONCE)
                found = pa.array(convert(tokenizer, part.column(at).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), found], names=shape.names)

    return rows.mapInArrow(run, shape)


def encode_column(docs: DataFrame, ranks_file: str | None = None, pattern: str | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of a text column, as little-endian unsigned 32-bit integers."""
    def convert(tokenizer, texts):
        return tokenizer.encode([t or "" for t in texts])

    return _mapped(docs, text, into, _files(ranks_file, pattern), convert)


def decode_column(rows: DataFrame, ranks_file: str | None = None, pattern: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of an id column."""
    def convert(tokenizer, values):
        return [None if x is None else tokenizer.decode(x) for x in values]

    return _mapped(rows, ids, into, _files(ranks_file, pattern), convert)


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's number of ids, their digest and that of the bytes they decode to."""
    docs = documents(spark, folder).select("doc_id", whole_text().alias("text"))
    encoded = encode_column(docs).select("doc_id", "ids")
    return decode_column(encoded).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op11_byte_bpe": op11_byte_bpe}
SQL: dict[str, str] = {}
