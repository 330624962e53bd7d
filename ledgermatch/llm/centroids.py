"""Centroid clustering (Lloyd's rounds on integer vectors) with heap-ordered bounds.

Vectors lie in blocks. A block keeps, per cluster, a heap of its vectors by the gap between the distance to the
second nearest centroid (lower bound for all others) and that to their own (upper bound). When centroids
move, a cluster's gaps can shrink by at most its own move and the largest move of another one; that drift is
added up per cluster, and a vector's key is its gap when it was last measured plus the drift up to then. So
only vectors whose key has been passed by the drift are popped; they are measured exactly against all
centroids and pushed again, all others stay where they are without being looked at. Ties and what
rounding could hide have no positive gap and are always popped.

Sums per cluster are kept from round to round: a task reports only what its moved vectors add and take away.
The vectors are written once, bucketed by block; each round reads them beside the heaps of the round before,
bucketed the same way, so nothing is shuffled between rounds but sums. The driver holds k centroids.

Defined results
- Components are integers; everything that decides (distances, sums, floors) is exact. Of equally near centroids
  the smaller number wins. An empty cluster keeps its centroid.
- Vectors are kept if they have exactly ``DIMS`` components, none null, NaN or infinite. Components beyond
  2 ** 26 in size count as 2 ** 26, so that a distance fits a long; sums beyond a long count as the largest long.
- First centroids: the kept rows with the smallest digests, rows of equal digests by their components; rows
  without a vec_id come last and by their components. Fewer rows than k: as many clusters as rows.
- Repeated vectors and repeated ids are rows of their own. An empty table gives an empty result.
- Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgermatch.llm.common import materialise, scratch_path

DIMS, K, ROUNDS = 64, 40, 5
SCALE, BOUND = 256, 1 << 26
_BLOCK = 2048
_SLACK = 1e-3  # beyond what rounding can do to a difference of roots of integers below 2 ** 60
_LARGEST = 2**63 - 1
_HEAPS = "block bigint, members binary, ends binary, keys binary, delta array<bigint>"

Heap = list[tuple[float, int]]


# --- a block -----------------------------------------------------------------------------------------

def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors x centroids) of integer rows."""
    largest = max(int(np.abs(x).max(initial=0)) for x in (vectors, centroids))
    if 4 * vectors.shape[1] * largest * largest < 1 << 53:  # every sum is an integer that a double holds
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    wide = vectors.astype(np.int64)
    return np.stack([((wide - c) ** 2).sum(1) for c in centroids.astype(np.int64)], 1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, gap between the second nearest distance and the nearest)."""
    squared = squared_distances(vectors, centroids)
    own = squared.argmin(1)
    first = squared[np.arange(len(own)), own]
    if len(centroids) == 1:
        return own, np.full(len(own), np.inf)
    second = np.partition(squared, 1, 1)[:, 1]
    return own, np.sqrt(second) - np.sqrt(first)


class Block:
    """Vectors with their heaps, one per cluster; an entry is (key, row)."""

    def __init__(self, vectors: np.ndarray, heaps: list[Heap]):
        self.vectors, self.heaps = vectors, heaps
        self.measured = 0

    @classmethod
    def fresh(cls, vectors: np.ndarray, k: int) -> Block:
        return cls(vectors, [[] for _ in range(k)])

    def _push(self, rows: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> np.ndarray:
        own, gap = nearest(self.vectors[rows], centroids)
        for row, c, key in zip(rows.tolist(), own.tolist(), (gap + drift[own]).tolist()):
            heapq.heappush(self.heaps[c], (key, row))
        self.measured += len(rows)
        return own

    def assign(self, centroids: np.ndarray, drift: np.ndarray, delta: np.ndarray) -> None:
        """Move the vectors whose gap has expired. ``delta`` (k x dims + 1) takes what sums and counts change by."""
        wide = lambda rows: np.concatenate([self.vectors[rows], np.ones((len(rows), 1), np.int32)], 1).astype(np.int64)
        if not any(self.heaps):
            rows = np.arange(len(self.vectors))
            np.add.at(delta, self._push(rows, centroids, drift), wide(rows))
            return
        popped, left = [], []
        for c, heap in enumerate(self.heaps):
            limit = drift[c] + _SLACK
            while heap and heap[0][0] <= limit:
                popped.append(heapq.heappop(heap)[1])
                left.append(c)
        if popped:
            rows, old = np.array(popped), np.array(left)
            new = self._push(rows, centroids, drift)
            moved = new != old
            np.add.at(delta, new[moved], wide(rows[moved]))
            np.subtract.at(delta, old[moved], wide(rows[moved]))

    def clusters(self) -> np.ndarray:
        out = np.empty(len(self.vectors), np.int64)
        for c, heap in enumerate(self.heaps):
            out[[row for _, row in heap]] = c
        return out

    def packed(self) -> tuple[bytes, bytes, bytes]:
        entries = [entry for heap in self.heaps for entry in heap]
        ends = np.cumsum([0, *map(len, self.heaps)])
        return (np.array([row for _, row in entries], "<i4").tobytes(), ends.astype("<i4").tobytes(),
                np.array([key for key, _ in entries], "<f8").tobytes())

    @classmethod
    def unpacked(cls, vectors: np.ndarray, members: bytes, ends: bytes, keys: bytes) -> Block:
        ends, entries = np.frombuffer(ends, "<i4").tolist(), list(zip(np.frombuffer(keys, "<f8").tolist(), np.frombuffer(members, "<i4").tolist()))
        return cls(vectors, [entries[a:b] for a, b in zip(ends, ends[1:])])  # written in heap order


# --- Spark --------------------------------------------------------------------------------------------

def kept_vectors(rows: DataFrame, column: str = "embedding", dims: int = DIMS) -> DataFrame:
    """vec_id and components (array<int>) of the rows that are kept."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int")
    return rows.where((F.size(column) == dims) & F.forall(column, fine)).select("vec_id", F.transform(column, whole).alias("components"))


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The ``k`` vectors with the smallest digests of ``2:<vec_id>``; k rows come to the driver."""
    digest = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(digest.alias("digest"), "components").orderBy(F.col("digest").asc_nulls_last(), "components").limit(k).collect()
    return np.array([r["components"] for r in first], np.int64)


def _blocks(vectors: DataFrame) -> DataFrame:
    """block, vec_ids, vectors (binary int32, row by row)."""
    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                data = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 33 | number], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                    names=["block", "vec_ids", "vectors"])
                number += 1

    return vectors.mapInArrow(run, "block bigint, vec_ids array<bigint>, vectors binary")


class _Tables:
    """Bucketed tables in the shared folder under names that go again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names, self.buckets = spark, [], int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, rows: DataFrame) -> DataFrame:
        self.names.append(name := f"blocks_{uuid.uuid4().hex}")
        rows.write.bucketBy(self.buckets, "block").option("path", scratch_path(self.spark)).saveAsTable(name)
        return self.spark.table(name)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _rows(batches, width: int) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
            yield row, np.frombuffer(row["vectors"], "<i4").reshape(-1, width)


def _round(blocks: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The heaps after one assignment, and a row without a block per task with what its sums change by."""
    k, width = centroids.shape

    def run(batches):
        delta = np.zeros((k, width + 1), np.int64)
        for row, vectors in _rows(batches, width):
            block = Block.unpacked(vectors, row["members"], row["ends"], row["keys"]) if "members" in row else Block.fresh(vectors, k)
            block.assign(centroids, drift, delta)
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "members", "ends", "keys"), (row["block"], *block.packed())), delta=None)], shape)
        if delta.any():
            yield pa.RecordBatch.from_pylist([{"delta": delta.ravel().tolist()}], shape)

    shape = pa.schema([("block", pa.int64()), ("members", pa.binary()), ("ends", pa.binary()), ("keys", pa.binary()), ("delta", pa.list_(pa.int64()))])
    return blocks.mapInArrow(run, _HEAPS)


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every vector, the centroids) after ``rounds`` rounds from ``centroids``."""
    k, width = centroids.shape
    tables, drift = _Tables(vectors.sparkSession), np.zeros(k)
    sums = [[0] * (width + 1) for _ in range(k)]
    try:
        base = tables.write(_blocks(vectors).repartition(tables.buckets, "block"))
        joined = base.select("block", "vectors")
        for _ in range(rounds):
            heaps = tables.write(_round(joined, centroids, drift))
            change = heaps.where("block IS NULL").select(F.posexplode("delta").alias("place", "value"))
            for place, value in change.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():  # k x (width + 1) rows
                sums[place // (width + 1)][place % (width + 1)] += int(value)
            moved = np.array([[x // s[-1] for x in s[:-1]] if s[-1] else old for s, old in zip(sums, centroids.tolist())], np.int64)
            move = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(1))
            others = np.array([np.delete(move, c).max(initial=0) for c in range(k)])
            centroids, drift = moved, drift + move + others
            state = heaps.where("block IS NOT NULL").drop("delta").hint("shuffle_hash")
            joined = base.select("block", "vec_ids", "vectors").join(state, "block")

        def last(batches):
            unused = np.zeros((k, width + 1), np.int64)
            for row, part in _rows(batches, width):
                block = Block.unpacked(part, row["members"], row["ends"], row["keys"])
                block.assign(centroids, drift, unused)
                own = block.clusters()
                away = ((part.astype(np.int64) - centroids[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(own.astype(np.int32)), pa.array(away)],
                                                 names=["vec_id", "cluster", "distance"])

        return materialise(joined.mapInArrow(last, "vec_id bigint, cluster int, distance bigint")), centroids
    finally:
        tables.close()


def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Every kept vector's cluster and distance, the clusters' inertias and digests of their centroids."""
    vectors = kept_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    first = first_centroids(vectors)
    shape = "cluster int, centroid_sha256 string"
    if not len(first):
        found = vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        digests = spark.createDataFrame([], shape)
    else:
        found, centroids = cluster(vectors, first)
        digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())], shape)
    fits = lambda x: F.least(x, F.lit(_LARGEST).cast("decimal(38,0)")).cast("long")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    per_cluster = digests.join(sums, "cluster").select(  # at most k rows
        "cluster", fits(F.col("sum")).alias("cluster_inertia"), fits(F.sum("sum").over(Window.partitionBy())).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    away = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))"
    whole = "CAST(floor(greatest(least(256 * CAST(x AS DOUBLE), 67108864), -67108864)) AS BIGINT)"
    parts = [f"""WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: {whole}) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
centroids_0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS cluster, v AS c FROM vectors QUALIFY cluster < 40)"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""assigned_{r} AS MATERIALIZED (
  SELECT v.row, v.vec_id, v.v, c.cluster, c.c, CAST({away} AS BIGINT) AS distance FROM vectors v, centroids_{r} c
  QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY distance, c.cluster) = 1)""")
        if r < ROUNDS:
            parts.append(f"""sums_{r} AS (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT cluster, v, unnest(range(1, 65)) AS i FROM assigned_{r}) GROUP BY ALL),
centroids_{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.c, c.c) AS c FROM centroids_{r} c LEFT JOIN (
    SELECT cluster, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM sums_{r} GROUP BY cluster) m USING (cluster))""")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM assigned_{ROUNDS}"""


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}

SQL = {"op12_centroid_clustering": _sql()}
