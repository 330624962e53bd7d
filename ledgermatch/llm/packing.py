"""Token ids packed into matrices of fixed width, written as binary columns.

Documents are encoded, closed with an end id and split into pieces of at most ``width`` ids. The pieces a
task has gathered are packed by best fit decreasing: the largest first, each into the fullest row that
still holds it. That row is found in a segment tree over the free capacities 0 .. width, in log(width)
steps. Pieces never lose or change an id; a row's cumulative lengths say where its segments are.

A row of the result is one matrix of up to ``matrix_rows`` packed rows:
    ids         little-endian int32, n_rows x width, filled up with ``pad``
    cu_seqlens  per packed row the cumulative segment lengths, from 0
    resets      per packed row the columns at which positions start again at 0
    doc_ids     per packed row the documents of its segments
    offsets     per packed row the segments' first id's place in their document

Packing works on what a task holds (``PACK_IDS`` ids at a time), so nothing is shuffled and memory does
not depend on the corpus; per such group less than half a row is lost against packing all at once.

Defined results
- Null and empty texts have no ids and appear in no matrix; an empty table gives no matrices.
- Equal rows are packed each for itself; a null doc_id is carried as null.
- Special tokens' names in a text are ordinary text.
- Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm.common import documents, scratch_path

RANKS_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
WIDTH, MATRIX_ROWS = 2048, 64
PACK_IDS = 1 << 21
# Fixed value of the rank file's format: how text is split before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RUN = re.compile(r"\s\s|^\s|\s$")
_CACHED = 300_000
_SHAPE = ("n_rows int, width int, ids binary, cu_seqlens array<array<int>>, resets array<array<int>>, "
          "doc_ids array<array<long>>, offsets array<array<int>>")


class _Encoder(dict):
    """Ids by stretch between single spaces; such a space always begins a new part of the split.

    Two generations: when the young one is full it becomes the old one, and stretches still in use move back.
    """

    def __init__(self, ranks: bytes):
        import tiktoken
        super().__init__()
        parts = (line.split() for line in ranks.splitlines())
        self.table = {base64.b64decode(a): int(b) for a, b in parts}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.table, special_tokens={})
        self.end = max(self.table.values()) + 1  # the free id after the ranks
        self.old: dict[str, bytes] = {}

    def __missing__(self, stretch: str) -> bytes:
        found = self.old.get(stretch)
        if found is None:
            found = array("i", self.encoding.encode_ordinary(" " + stretch)).tobytes()
        if len(stretch) <= 48:
            if len(self) >= _CACHED:
                self.old = dict(self)
                self.clear()
            self[stretch] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if _RUN.search(text):
            return np.array(self.encoding.encode_ordinary(text), np.int32)
        first, *rest = text.split(" ")
        begin = array("i", self.encoding.encode_ordinary(first)).tobytes()
        return np.frombuffer(b"".join([begin, *map(self.__getitem__, rest)]), np.int32)


@lru_cache(2)
def _encoder(ranks: bytes) -> _Encoder:
    return _Encoder(ranks)


def best_fit_decreasing(sizes: np.ndarray, width: int) -> list[list[int]]:
    """Rows of piece numbers; no row's sizes sum to more than ``width``."""
    base = 1 << width.bit_length()
    filled = [0] * (2 * base)                       # rows by free capacity, summed up the tree
    free: list[list[int]] = [[] for _ in range(width + 1)]
    rows: list[list[int]] = []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        node = base + size
        if not filled[node]:                        # up until a neighbour to the right holds something
            while node > 1 and (node & 1 or not filled[node + 1]):
                node //= 2
            node += node > 1
        if node > 1:
            while node < base:                      # down to the smallest of it
                node = 2 * node if filled[2 * node] else 2 * node + 1
            capacity = node - base
            row = free[capacity].pop()
            step = -1
        else:
            row, capacity, step = len(rows), width, 0
            rows.append([])
        rows[row].append(piece)
        for place, change in ((base + capacity, step), (base + capacity - size, 1)):
            while change and place:
                filled[place] += change
                place //= 2
        free[capacity - size].append(row)
    return rows


def pack(docs: DataFrame, ranks_file: str = RANKS_FILE, width: int = WIDTH, matrix_rows: int = MATRIX_ROWS, pad: int = 0) -> DataFrame:
    """The matrices of ``docs`` (doc_id, text)."""
    with open(ranks_file, "rb") as f:
        ranks = f.read()  # under a megabyte; read once by the driver

    def matrices(pieces: list[tuple]) -> pa.RecordBatch:
        """pieces: (doc_id, offset, ids)"""
        rows = best_fit_decreasing(np.array([len(p[2]) for p in pieces]), width)
        out = []
        for at in range(0, len(rows), matrix_rows):
            part = rows[at:at + matrix_rows]
            ids = np.full((len(part), width), pad, "<i4")
            ends = [np.cumsum([0, *(len(pieces[p][2]) for p in row)]).tolist() for row in part]
            for line, row, end in zip(ids, part, ends):
                line[:end[-1]] = np.concatenate([pieces[p][2] for p in row])
            out.append((len(part), width, ids.tobytes(), ends, [e[:-1] for e in ends],
                        [[pieces[p][0] for p in row] for row in part], [[pieces[p][1] for p in row] for row in part]))
        kinds = [pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.list_(pa.int32()))] * 2,
                 pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int32()))]
        names = ["n_rows", "width", "ids", "cu_seqlens", "resets", "doc_ids", "offsets"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    def run(batches):
        encoder = _encoder(ranks)
        pieces, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                ids = np.append(encoder.encode(text), np.int32(encoder.end))
                pieces += [(doc_id, at, ids[at:at + width]) for at in range(0, len(ids), width)]
                held += len(ids)
                if held >= PACK_IDS:
                    yield matrices(pieces)
                    pieces, held = [], 0
        if pieces:
            yield matrices(pieces)

    return docs.select("doc_id", "text").mapInArrow(run, _SHAPE)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the matrices as Parquet with binary columns."""
    pack(docs, **options).write.mode("overwrite").parquet(path)


def segments(packed: DataFrame) -> DataFrame:
    """doc_id, offset, ids (int32 bytes) of every segment: what a reader needs to put documents together again."""
    rows = packed.select("width", "ids", F.posexplode(F.arrays_zip("cu_seqlens", "doc_ids", "offsets")).alias("row", "r"))
    parts = rows.select("width", "ids", "row", "r", F.posexplode("r.doc_ids").alias("i", "doc_id"))
    begin, end = F.col("r.cu_seqlens")[F.col("i")], F.col("r.cu_seqlens")[F.col("i") + 1]
    return parts.select("doc_id", F.col("r.offsets")[F.col("i")].alias("offset"),
                        F.substring("ids", 4 * (F.col("row") * F.col("width") + begin) + 1, 4 * (end - begin)).alias("ids"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the matrices; returns one row per written matrix with its digest, fill and documents."""
    path = scratch_path(spark)
    write_packed(documents(spark, folder), path)
    return spark.read.parquet(path).select(
        F.sha2("ids", 256).alias("ids_sha256"), F.col("n_rows").cast("long").alias("n_rows"), "width",
        F.aggregate("cu_seqlens", F.lit(0).cast("long"), lambda a, x: a + F.element_at(x, -1)).alias("n_ids"),
        F.flatten("doc_ids").alias("doc_ids"), F.flatten("offsets").alias("offsets"), "cu_seqlens", "resets")


QUERIES = {"op10_packing": op10_packing}
SQL: dict[str, str] = {}
