import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermatch.llm import centroids

SHAPE = "vec_id long, embedding array<float>"


def brute(rows, k=40, rounds=5):
    """The contract, in plain Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(1 << 26), min(1 << 26, x)) for x in v]) for i, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    away = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    place = lambda v: min(range(len(c)), key=lambda j: (away(v, c[j]), j))
    for _ in range(rounds):
        own = [place(v) for _, v in kept]
        c = [[sum(col) // len(members) for col in zip(*members)] if (members := [v for (_, v), o in zip(kept, own) if o == j]) else c[j] for j in range(len(c))]
    own = [place(v) for _, v in kept]
    gone = [away(v, c[o]) for (_, v), o in zip(kept, own)]
    per = {j: sum(g for g, o in zip(gone, own) if o == j) for j in set(own)}
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    limit = 2**63 - 1
    return sorted([(i, o, g, min(per[o], limit), min(sum(gone), limit), digest[o]) for (i, _), o, g in zip(kept, own, gone)], key=str)


def query(spark, folder, rows, more=()):
    frame = spark.createDataFrame(rows, SHAPE).select("*", *(F.lit("x").alias(c) for c in more))
    frame.write.parquet(str(folder / "embeddings.parquet"))
    return sorted(map(tuple, centroids.op12_centroid_clustering(spark, str(folder)).collect()), key=str)


def narrow(v):
    return [float(np.float32(x)) for x in v]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    middles = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(25)]
    rows = [(i, narrow(m + rng.gauss(0, 0.1) for m in rng.choice(middles))) for i in range(400)]
    rows += [(rng.randrange(400), rows[3][1]) for _ in range(150)]  # a third are copies, under ids used twice
    assert query(spark, tmp_path, rows, ("cluster", "distance", "block", "digest", "label")) == brute(rows)


def test_odd_vectors_ties_and_large_components(spark, tmp_path):
    rng = random.Random(2)
    flat = [(i, [rng.choice([-0.5, 0.0, 0.5])] * 64) for i in range(60)]  # many equally near centroids
    odd = [(100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 65), (104, [math.nan] * 64), (105, [0.0] * 63 + [math.inf]), (106, [None] * 64),
           (None, [0.25] * 64), (None, [0.5] * 64), (107, narrow([3e38] * 64)), (108, narrow([-3e38] * 64)), (109, narrow([1e5] * 64))]
    assert query(spark, tmp_path, flat + odd) == brute(flat + odd)


@pytest.mark.parametrize("rows", [[], [(5, [0.1] * 64)], [(5, [0.1] * 64), (5, [0.1] * 64), (6, None)]])
def test_fewer_vectors_than_clusters(spark, tmp_path, rows):
    rows = [(i, v and narrow(v)) for i, v in rows]
    assert query(spark, tmp_path, rows) == brute(rows)


def test_bounds_leave_most_vectors_alone_and_change_nothing():
    rng = np.random.default_rng(3)
    middles = rng.integers(-800, 800, (12, 8))
    vectors = (middles[rng.integers(0, 12, 6000)] + rng.integers(-60, 60, (6000, 8))).astype(np.int32)
    c, drift = vectors[:12].astype(np.int64), np.zeros(12)
    block = centroids.Block.fresh(vectors, 12)
    sums, measured = np.zeros((12, 9), np.int64), []
    for _ in range(8):
        before = block.measured
        block.assign(c, drift, sums)
        measured.append(block.measured - before)
        own = centroids.squared_distances(vectors, c).argmin(1)
        assert (block.clusters() == own).all()
        assert (sums[:, -1] == np.bincount(own, minlength=12)).all()
        assert all((sums[j, :-1] == vectors[own == j].sum(0)).all() for j in range(12))
        block = centroids.Block.unpacked(vectors, *block.packed())
        block.measured = sum(measured)
        moved = np.where(sums[:, -1:] > 0, sums[:, :-1] // np.maximum(sums[:, -1:], 1), c)
        move = np.sqrt(((moved - c) ** 2).sum(1))
        drift += move + np.array([np.delete(move, j).max() for j in range(12)])
        c = moved
    assert measured[0] == 6000 and max(measured[3:]) < 600  # once the centroids settle, few are looked at


def test_distances_are_exact_at_any_size():
    rng = np.random.default_rng(4)
    for bound in (10, 1 << 20, 1 << 26):
        v, c = rng.integers(-bound, bound + 1, (50, 64)), rng.integers(-bound, bound + 1, (7, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
        assert centroids.squared_distances(v, c).tolist() == want
