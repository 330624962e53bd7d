import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgermatch.llm import merkle
from ledgermatch.operators.numbering import numbered
from tests.llm.helpers import LONG, odd_documents

SHAPE = "doc_id long, source string, lang string, n_chars long, text string"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i:i + 3])) for i in range(0, len(below), 3)])
    return levels


def way(levels, at):
    """(siblings to the left, to the right) on each level."""
    for nodes in levels[:-1]:
        start = at - at % 3
        yield nodes[start:at], nodes[at + 1:start + 3]
        at //= 3


def brute(rows) -> list[tuple]:
    """The contract, in plain Python. rows: (doc_id, source, lang, n_chars, text)"""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    key = lambda x: (x is not None, x if x is not None else 0)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in sorted(sources[s], key=lambda r: (key(r[0]), leaf(r)))]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for at, row in enumerate(sorted(sources[s], key=lambda r: (key(r[0]), leaf(r)))):
            struck = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            found, siblings = leaf((*row[:4], row[4].replace("\n", "")) if struck else row), ""
            for left, right in [*way(trees[s], at), *way(top, place)]:
                siblings += "".join(left + right)
                found = h("".join(left) + found + "".join(right))
            out.append((row[0], leaf(row), trees[s][-1][0], top[-1][0], h(siblings), found, found == top[-1][0]))
    return sorted(out, key=str)


def query(spark, folder, rows, more=None):
    docs = spark.createDataFrame(rows, SHAPE)
    (docs if more is None else more(docs)).write.parquet(str(folder / "documents.parquet"))
    return sorted(map(tuple, merkle.op13_merkle_manifest(spark, str(folder)).collect()), key=str)


def test_states_on_columns_equal_the_library():
    rng = np.random.default_rng(4)
    digests = [rng.bytes(32) for _ in range(40)]
    words = merkle._words(pa.array(digests))
    assert merkle._bytes(words).to_pylist() == digests
    state = np.repeat(merkle.START, 40, 1)
    for blocks in range(5):
        done = merkle.finish(state, np.full(40, blocks))
        assert merkle._bytes(done).to_pylist() == [hashlib.sha256(d.hex().encode() * blocks).digest() for d in digests]
        state = merkle.compress(state, merkle.hex_block(words))


def test_fold_resumes_the_state_and_never_reads_the_left():
    """The steps' left siblings may be anything: only the state, the replacement and the right siblings count."""
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(9)]
    steps, tops = merkle.grow(np.zeros(9, int), np.arange(9), np.full(9, 2), merkle._words(pa.array(digests)))
    spoilt = steps[:, :2].copy()
    for row in spoilt:
        for step in row:
            step["others"][:step["slot"]] = 7
    folded, _ = merkle.fold(merkle._words(pa.array(digests)), spoilt.reshape(-1), np.arange(10) * 2)
    assert (folded == tops).all() and merkle._bytes(tops).to_pylist()[0].hex() == tree([d.hex() for d in digests])[-1][0]


@pytest.mark.parametrize("sizes", [(1,), (9, 10, 28, 1, 2, 3, 4), (243, 244), (800, 40)])
def test_query_equals_brute_force(spark, tmp_path, sizes):
    rng = random.Random(sum(sizes))
    rows = [(i, f"s{k}", rng.choice(["en", None]), rng.randrange(99), rng.choice(["a\nb", "x", None, "\n", "é\n\n字"])) for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    assert query(spark, tmp_path, rows) == brute(rows)


def test_query_with_many_sources_nulls_ties_and_repeated_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", *(f"é{i}" for i in range(300))]), None, None, rng.choice(["t\n", "", None, LONG])) for _ in range(500)]
    rows += [(7, "hot", "en", 1, "same\n")] * 700  # one row, more copies than a block holds
    clash = lambda d: d.select("*", *(F.lit("x").alias(c) for c in ("leaf", "node", "position", "total", "root", "path", "found")))
    assert query(spark, tmp_path, rows, clash) == brute(rows)


def test_odd_documents_and_empty_table(spark, tmp_path):
    docs = odd_documents(spark)
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in docs.select("doc_id", "source", "lang", F.col("n_chars").cast("long"), "text").collect()]
    assert query(spark, tmp_path, rows) == brute(rows)
    assert query(spark, tmp_path / "empty", []) == []


def test_positions_are_counted_without_gaps(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("o"))
    found = numbered(rows.withColumn("g", F.expr("nullif(g, 2)")), ["g"], ["o"]).collect()
    for g in (None, 0, 1):
        mine = sorted((r["position"], (r["o"] is not None, r["o"] or 0)) for r in found if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [o for _, o in mine] == sorted(o for _, o in mine)
        assert {r["total"] for r in found if r["g"] == g} == {len(mine)}
