"""Merkle manifest of a dataset as a tree of SHA-256 midstates.

A leaf is the digest of one row. Per source the leaves stand in the order of their doc_id; every three
consecutive nodes become the digest of their digests, written as hex text, until one is left; the subroots
of the sources, in the order of the source, become the root in the same way.

A child's digest as hex text is 64 bytes, one whole block of the hash. So the state of a parent's hash before
each child's slot is eight words that can be copied and kept: the manifest keeps, per node and level, that
state, the slot and the digests of the other children. Folding a changed leaf resumes each parent's state at
the slot and hashes only the replacement and what stands to its right; nothing to the left is hashed again.

The tree grows ``LEVELS`` levels at a time. A task gets whole blocks of 3 ** LEVELS consecutive nodes, whatever
the size of a source; the blocks' tops are the nodes of the next step, and positions come from ranges of the
order that all tasks count at once. All nodes of a level are hashed together, the words as numpy columns.

Defined results
- A null in any column is hashed as ``-``. Rows without a doc_id come first; rows with one doc_id stand in the
  order of their leaves. Repeated rows are leaves of their own, and whichever copy has which place, the
  result has the same rows.
- A null source is a source of its own and comes first; an empty string is another one.
- A source of one row has its leaf as its subroot, a table of one source its subroot as its root; the siblings'
  digest of a lone row is that of no bytes.
- Very long texts are hashed by Spark; only digests travel. An empty table gives no rows and no root.
- Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm.common import documents, materialise
from ledgermatch.operators.numbering import numbered, same

FAN_OUT = 3
LEVELS = 5  # levels a task grows at once: blocks of 243 nodes
SPAN = FAN_OUT ** LEVELS
_ROWS = 1 << 14  # nodes hashed at once

#: One level of a leaf's way up: the parent's number of children, the slot, the state before it, the other children.
STEP = np.dtype([("n", "u1"), ("slot", "u1"), ("state", ">u4", 8), ("others", ">u4", (FAN_OUT - 1, 8))])


# --- SHA-256 on columns of words --------------------------------------------------------------------

def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle ** 3 <= x else (low, middle - 1)
    return low


# The first 32 bits of the fractional parts of the primes' square and cube roots.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)[:, None]
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8 x n) after one more block of 16 words (16 x n) each."""
    state = np.broadcast_to(state, (8, block.shape[1]))
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        i = t & 15
        if t >= 16:
            x, y = w[(t + 1) & 15], w[(t + 14) & 15]
            w[i] = (w[i] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))) + w[(t + 9) & 15]
                    + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
        first = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[i]
        second = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def hex_block(digest: np.ndarray) -> np.ndarray:
    """The blocks (16 x n) that digests (8 x n) fill as hex text."""
    halves = np.stack([digest >> np.uint32(16), digest & np.uint32(0xFFFF)], 1).reshape(16, -1)
    nibbles = sum(((halves >> np.uint32(4 * i)) & np.uint32(15)) << np.uint32(8 * i) for i in range(4))
    letters = ((nibbles + np.uint32(0x06060606)) >> np.uint32(4)) & np.uint32(0x01010101)
    return nibbles + np.uint32(0x30303030) + letters * np.uint32(ord("a") - ord("0") - 10)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of hashes that have taken ``blocks`` whole blocks."""
    last = np.zeros((16, len(blocks)), np.uint32)
    last[0] = 1 << 31
    last[15] = blocks.astype(np.uint32) * np.uint32(512)
    return compress(state, last)


def _words(digests: pa.Array) -> np.ndarray:
    """Binary digests as columns of words (8 x n)."""
    if not len(digests):
        return np.zeros((8, 0), np.uint32)
    data = b"".join(digests.to_pylist())
    return np.ascontiguousarray(np.frombuffer(data, ">u4").reshape(-1, 8).T).astype(np.uint32)


def _bytes(words: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(words.T).astype(">u4").tobytes()
    return pa.array([data[i:i + 32] for i in range(0, len(data), 32)], pa.binary())


# --- growing and folding ------------------------------------------------------------------------------

def rounds_of(total: np.ndarray) -> np.ndarray:
    """Levels up to a tree's top, ``LEVELS`` at most."""
    rounds, reach = np.zeros(len(total), np.int64), 1
    for _ in range(LEVELS):
        rounds += total > reach
        reach *= FAN_OUT
    return rounds


def grow(block: np.ndarray, place: np.ndarray, rounds: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps per node and level, the top above each node) of nodes that stand block by block, by ascending place."""
    steps = np.zeros((len(block), LEVELS), STEP)
    at = np.arange(len(block))  # each node's ancestor on the present level
    for level in range(int(rounds.max(initial=0))):
        going = rounds > level
        run = np.where(going, place // FAN_OUT, place)
        first = np.ones(len(block), bool)
        first[1:] = (block[1:] != block[:-1]) | (run[1:] != run[:-1])
        starts, parent = np.flatnonzero(first), np.cumsum(first) - 1
        size, slot, text = np.bincount(parent), np.arange(len(block)) - starts[parent], hex_block(nodes)
        states = np.empty((FAN_OUT + 1, 8, len(starts)), np.uint32)
        states[0] = START
        for s in range(FAN_OUT):
            has = np.flatnonzero((size > s) & going[starts])
            states[s + 1] = states[s]
            states[s + 1][:, has] = compress(states[s][:, has], text[:, starts[has] + s])
        above = np.where(going[starts], finish(states[-1], size), nodes[:, starts])
        own = going[at]
        mine, over = at[own], parent[at[own]]
        step = np.zeros(len(mine), STEP)
        step["n"], step["slot"] = size[over], slot[mine]
        step["state"] = states[slot[mine], :, over]
        for other in range(FAN_OUT - 1):
            which = other + (other >= slot[mine])
            has = which < size[over]
            step["others"][has, other] = nodes[:, starts[over[has]] + which[has]].T
        steps[own, level] = step
        at = parent[at]
        block, place, rounds, nodes = block[starts], run[starts], rounds[starts], above
    return steps, nodes[:, at]


def fold(leaves: np.ndarray, steps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the root that follows from each leaf, the digest of its siblings). ``ends``: of each leaf's steps, from 0."""
    at, proof, count = leaves.copy(), np.repeat(START, leaves.shape[1], 1), np.zeros(leaves.shape[1], np.int64)
    begins, lengths = ends[:-1], np.diff(ends)
    for level in range(int(lengths.max(initial=0))):
        rows = np.flatnonzero(lengths > level)
        step = steps[begins[rows] + level]
        others = np.ascontiguousarray(np.moveaxis(step["others"].astype(np.uint32), 0, 2))  # child x word x row
        state = compress(np.ascontiguousarray(step["state"].T).astype(np.uint32), hex_block(at[:, rows]))
        for other in range(FAN_OUT - 1):
            has = np.flatnonzero(step["n"] > other + 1)
            text = hex_block(others[other][:, has])
            proof[:, rows[has]] = compress(proof[:, rows[has]], text)
            count[rows[has]] += 1
            right = step["slot"][has] <= other
            state[:, has[right]] = compress(state[:, has[right]], text[:, right])
        at[:, rows] = finish(state, step["n"])
    return at, finish(proof, count)


# --- Spark --------------------------------------------------------------------------------------------

def leaf_digest(*columns: Column) -> Column:
    """SHA-256 (binary) of values, each ``-`` if null, else its length in UTF-8, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def document_leaf(text: str | Column = "text") -> Column:
    return leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), F.col(text) if isinstance(text, str) else text)


def _whole_blocks(batches, n_group: int):
    """Tables of whole blocks, and the number of each row's block. Columns: group, block, then others."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in (*batches, None):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
            if rows < _ROWS:
                continue
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows, bool)
        for i in range(n_group + 1):
            codes = table.column(i).combine_chunks()
            codes = codes.dictionary_encode().indices.fill_null(-1) if i < n_group else codes
            codes = codes.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        block = np.cumsum(change)
        ready = table.num_rows if batch is None else int(np.searchsorted(block, block[-1])) if table.num_rows else 0
        if ready:
            yield table.slice(0, ready), block[:ready]
        held, rows = table.slice(ready).to_batches(), table.num_rows - ready


def _step(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` (group, position, total, node, others) with the path inside their block and the block's top."""
    names = [c for c in rows.columns if c not in group]
    dealt = rows.select(*group, F.expr(f"position div {SPAN}").alias("__block"), *names)
    dealt = dealt.repartition(*group, "__block").sortWithinPartitions(*group, "__block", "position")
    shape = dealt.select("*", F.lit(b"").alias("path"), F.lit(b"").alias("top")).schema
    position, total, node = (dealt.columns.index(c) for c in ("position", "total", "node"))
    n_group = len(group)

    def run(batches):
        for table, block in _whole_blocks(batches, n_group):
            rounds = rounds_of(table.column(total).to_numpy())
            steps, tops = grow(block, table.column(position).to_numpy() % SPAN, rounds, _words(table.column(node)))
            paths = pa.array([s[:n].tobytes() for s, n in zip(steps, rounds.tolist())], pa.binary())
            yield from pa.Table.from_arrays([*table.columns, paths, _bytes(tops)], names=shape.names).to_batches()

    return dealt.mapInArrow(run, shape)


def _trees(rows: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(``rows`` with path and top inside their block, the same of the blocks up to each tree's top)."""
    tier = materialise(_step(rows, group))
    above = tier.where(f"position % {SPAN} = 0").select(
        *group, F.col("__block").alias("position"), F.expr(f"(total + {SPAN - 1}) div {SPAN}").alias("total"), F.col("top").alias("node"))
    if above.agg(F.max("total")).first()[0] in (None, 1):
        return tier, above.select(*group, "position", F.lit(b"").alias("path"), F.col("node").alias("top"))
    low, high = _trees(above, group)
    joined = low.alias("l").join(high.alias("h"), same("l", "h", group) & (F.col("l.__block") == F.col("h.position"))
                                 if group else F.col("l.__block") == F.col("h.position"))
    return tier, joined.select(*(F.col(f"l.{c}") for c in group), "l.position", F.concat("l.path", "h.path").alias("path"), "h.top")


@dataclass
class Manifest:
    """``leaves``: source, __block, doc_id, node, the carried columns, and path, the steps inside the block.
    ``blocks``: source, position, path from there to the root, subroot, root."""
    leaves: DataFrame
    blocks: DataFrame

    def proofs(self) -> DataFrame:
        """The leaves with their whole path, subroot and root."""
        on = F.col("l.source").eqNullSafe(F.col("b.source")) & (F.col("l.__block") == F.col("b.position"))
        kept = [c for c in self.leaves.columns if c not in ("path", "top", "position", "total", "__block")]
        return self.leaves.alias("l").join(self.blocks.alias("b"), on).select(
            *(F.col(f"l.{c}") for c in kept), F.concat("l.path", "b.path").alias("path"), "b.subroot", "b.root")


def manifest(docs: DataFrame, **carried: Column) -> Manifest:
    """The manifest of ``docs``; ``carried`` are further columns of its leaves."""
    leaves = docs.select("source", "doc_id", document_leaf().alias("node"), *(c.alias(name) for name, c in carried.items()))
    leaves = materialise(leaves)  # dealing by ranges reads its input twice: the digests, not the texts
    tier, blocks = _trees(numbered(leaves, ["source"], ["doc_id", "node"]), ["source"])
    blocks = materialise(blocks)
    sources = numbered(blocks.where("position = 0").select("source", F.col("top").alias("node")), [], ["source"])
    low, high = _trees(sources, [])
    to_root = low.alias("l").join(high.alias("h"), F.col("l.__block") == F.col("h.position")).select(
        "l.source", F.col("l.node").alias("subroot"), F.concat("l.path", "h.path").alias("path"), F.col("h.top").alias("root"))
    joined = blocks.alias("b").join(to_root.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(
        "b.source", "b.position", F.concat("b.path", "s.path").alias("path"), "s.subroot", "s.root")
    return Manifest(tier, materialise(joined))


def fold_rows(proofs: DataFrame, leaf: str) -> DataFrame:
    """``proofs`` with ``folded``, the root that follows from the column ``leaf``, and ``siblings``, their digest; no path."""
    kept = [c for c in proofs.columns if c != "path"]
    shape = proofs.select(*kept, F.lit(b"").alias("folded"), F.lit(b"").alias("siblings")).schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                paths = part.column(part.schema.get_field_index("path")).to_pylist()
                steps = np.frombuffer(b"".join(paths), STEP)
                ends = np.cumsum([0, *(len(p) // STEP.itemsize for p in paths)])
                folded, siblings = fold(_words(part.column(part.schema.get_field_index(leaf))), steps, ends)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in kept), _bytes(folded), _bytes(siblings)], names=shape.names)

    return proofs.mapInArrow(run, shape)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf and proof, and the root that follows after some texts have lost their line breaks."""
    docs = documents(spark, folder)
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(struck, F.translate("text", "\n", "")).otherwise(F.col("text"))
    folded = fold_rows(manifest(docs, found=document_leaf(text)).proofs(), "found")
    as_hex = lambda c: F.lower(F.hex(c))
    return folded.select(
        "doc_id", as_hex("node").alias("leaf"), as_hex("subroot").alias("subroot"), as_hex("root").alias("root"),
        as_hex("siblings").alias("proof_sha256"), as_hex("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}

def _sql_tree(name: str, base: str, key: str) -> str:
    """Nodes of trees in SQL, and each node's siblings to its left and right."""
    return f"""
{name} AS (
  SELECT * FROM {base}
  UNION ALL
  SELECT {key}, level + 1, p // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY p)) FROM {name} WHERE n > 1 GROUP BY {key}, level, p // 3),
{name}_siblings AS (
  SELECT {key}, level, p, n, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY {key}, level, p // 3 ORDER BY p))"""


def _sql_fold(name: str, base: str, tree: str, key: str) -> str:
    return f"""
{name} AS (
  SELECT * FROM {base}
  UNION ALL
  SELECT f.id, f.{key}, f.level + 1, f.p // 3, sha256(s.before || f.h || s.after), f.siblings || s.before || s.after
  FROM {name} f JOIN {tree}_siblings s ON s.{key} IS NOT DISTINCT FROM f.{key} AND s.level = f.level AND s.p = f.p),
{name}_end AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)"""


def _sql_part(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


_SQL_LEAF = "sha256(" + " || ".join(_sql_part(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_SQL_CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

SQL = {"op13_merkle_manifest": f"""
WITH RECURSIVE
docs AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {_SQL_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS struck FROM documents),
leaves AS (
  SELECT row_number() OVER () AS id, doc_id, source, leaf, found,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_SQL_LEAF.format(text="text")} AS leaf, {_SQL_LEAF.format(text="struck")} AS found FROM docs)),
base AS (SELECT source, 0 AS level, p, n, leaf AS h FROM leaves),{_sql_tree("nodes", "base", "source")},
sources AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
top_base AS (SELECT 0 AS tree, 0 AS level, p, n, subroot AS h FROM sources),{_sql_tree("tops", "top_base", "tree")},
low AS (SELECT id, source, 0 AS level, p, found AS h, '' AS siblings FROM leaves),{_sql_fold("low_top", "low", "nodes", "source")},
high AS (SELECT l.id, 0 AS tree, 0 AS level, s.p, l.h, l.siblings FROM low_top_end l JOIN sources s ON s.source IS NOT DISTINCT FROM l.source),
{_sql_fold("high_top", "high", "tops", "tree").lstrip()}
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(u.siblings) AS proof_sha256, u.h AS folded_root, u.h = t.h AS verified
FROM leaves l JOIN sources s ON s.source IS NOT DISTINCT FROM l.source JOIN high_top_end u ON u.id = l.id JOIN tops t ON t.n = 1
"""}
