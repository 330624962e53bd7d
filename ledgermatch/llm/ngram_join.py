r"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), returning classes of linked documents.

A document's set holds its distinct word n-grams; two documents link when 100 * common >= percent * union,
so a document of s n-grams needs a partner that shares at least T = ceil(percent * s / 100) of them.

1. Documents with equal sets are one node.
2. Under any order that all nodes agree on, two linked nodes share at least l n-grams among their first
   s - T + l. The order is by hash, with n-grams found in more than 1/1000 of all documents (at least 32)
   last, the most frequent at the very end; so passages that many documents share rarely decide anything.
   Such n-grams are at most 1000 times the mean set size in number; that bounds what the tasks are sent.
   l is 1 + ``EXTRA`` percent of s. N-grams that no other node has are dropped; nodes that keep too few
   have no partner and go.
3. The remaining nodes are linked to the smallest node of each n-gram. The components of these star links
   are *cells*: linked documents are always in one cell, and no pairs have been listed so far.
4. Within a cell the T-occurrence search runs over inverted lists: the short lists of a query's n-grams
   are heap-merged, documents found in at least T - L of them are probed in the L long lists by binary
   search. Pairs that are already connected are passed over, as only classes are wanted.
5. A cell with more than ``BLOCK`` n-grams is dealt over blocks. Each block is searched by itself; then a
   few members of every sizeable class meet in hub blocks, which mostly joins the classes of a family of
   near copies; then documents without enough n-grams that other classes of the cell have too are done with.
6. Of the rest, only n-grams found in several classes of the cell count. Ordered by how many documents have them, rarest
   first, two linked documents of r such n-grams share one of their first r - T + 1. Every document is measured against
   one that many of these have in common with it, which joins most families; then all pairs that still have one in common
   and differ in class, if what follows the n-gram in both is enough. An n-gram among the first of more than ``FEW`` documents
   lists no pairs: its documents form families, in which every document outside the largest class is searched against all blocks.
   No two documents of different classes are left uncompared, and no task holds more than two blocks.

N-grams are 64-bit hashes of their words; two documents of 1,000 n-grams mistake different ones for equal
with a probability of about 1e-13.

Defined results
- Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z. With fewer than n words the whole sequence is
  the one n-gram. A null or blank text has an empty set and links with nothing, not even another one.
- One row per input row: doc_id, n_shingles, component_id. Rows with a null doc_id get a null component
  and take no part. Rows that share a doc_id share their links.
- Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import documents, materialise, possible, release_shuffles
from ledgermatch.llm.components import connected_components

BLOCK = 1_500_000          # n-grams per block of a cell
HOT_SHARE, HOT_LEAST = 1000, 32
EXTRA = 6
FEW = 32                   # documents that share a first n-gram and are compared in pairs
_BATCH_KEYS = 4_000_000    # n-grams counted together in a task
_HUB_FROM, _HUB_MEMBERS = 16, 8
_LEADERS = 8
_MU = 0.0085               # weight of the merge against the probes when the long lists are chosen
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# --- sets -----------------------------------------------------------------------------------------

class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def ngram_keys(text: str | None, n: int, hashes: dict) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    words = text.encode().lower().split() if text else []  # bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    key = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        key *= _A
        key += h[i:len(h) - width + 1 + i]
    key ^= key >> np.uint64(31)
    key *= _B
    key ^= key >> np.uint64(29)
    return np.unique(key)


def _required(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def _linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the frequent n-grams and their order class (log2 of the document count).

    Tasks report what is frequent among the documents they hold; an n-gram can be missed where its
    documents are thinly spread, which costs time later but changes no result.
    """
    def count(batches):
        hashes, held, size, rows, seen = _WordHashes(), [], 0, 0, 0

        def flush():
            key, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= max(8, rows / (HOT_SHARE / 2))
            return pd.DataFrame({"key": key[often].view(np.int64), "n": times[often].astype(np.int64)})

        for batch in batches:
            for text in batch["text"]:
                held.append(ngram_keys(text, n, hashes))
                size, rows, seen = size + len(held[-1]), rows + 1, seen + 1
                if size >= _BATCH_KEYS:
                    yield flush()
                    held, size, rows = [], 0, 0
        if held:
            yield flush()
        yield pd.DataFrame({"key": [None], "n": [seen]}).astype({"key": "Int64"})

    counted = materialise(docs.select("text").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total = counted.where("key IS NULL").agg(F.sum("n")).first()[0] or 0
    hot = counted.where(F.col("key").isNotNull() & (F.col("n") >= max(HOT_LEAST, total / HOT_SHARE))).toPandas()
    keys = hot["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.log2(hot["n"].to_numpy(float)[order]).astype(np.int8)


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size, digest, node (the digest's first half), and the first n-grams: rare ones, frequent ones."""
    hot = docs.sparkSession.sparkContext.broadcast(_frequent(docs, n))
    none = np.empty(0, np.int64)

    def build(batches):
        hashes = _WordHashes()
        keys_hot, classes = hot.value
        for batch in batches:
            sizes, digests, nodes, rare, frequent = [], [], [], [], []
            for text in batch["text"]:
                keys = ngram_keys(text, n, hashes)
                digest = xxhash.xxh3_128_digest(keys.tobytes())
                sizes.append(len(keys))
                digests.append(digest)
                nodes.append(int.from_bytes(digest[:8], "little", signed=True))
                take = len(keys) - _required(len(keys), percent) + 1 + EXTRA * len(keys) // 100 if len(keys) else 0
                late = none
                if len(keys_hot) and take:
                    at = np.minimum(np.searchsorted(keys_hot, keys), len(keys_hot) - 1)
                    is_hot = keys_hot[at] == keys
                    if is_hot.any():
                        late = keys[is_hot][np.argsort(classes[at[is_hot]], kind="stable")]
                        keys = keys[~is_hot]
                rare.append(keys[:take].view(np.int64))
                frequent.append(late[:max(0, take - len(keys))].view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "size": sizes, "digest": digests, "node": nodes, "rare": rare, "frequent": frequent})

    return docs.select("doc_id", "text").mapInPandas(
        build, "doc_id long, size long, digest binary, node long, rare array<long>, frequent array<long>")


def _shared(sets: DataFrame) -> DataFrame:
    """(key, node): the first n-grams that more than one node has."""
    def several(batches):
        """The rows come sorted; of every key's run the different nodes, if there are two or more."""
        last_key = last_node = None
        alone = False  # the last row is its key's only one so far
        for batch in batches:
            if not len(batch):
                continue
            keys, nodes = batch["key"].to_numpy(), batch["node"].to_numpy()
            if last_key is not None:
                keys, nodes = np.append(last_key, keys), np.append(last_node, nodes)
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            if last_key is not None and not alone:
                fresh[0] = False  # given out before, it only shows that its key's run goes on
            begins = np.ones(len(keys), bool)
            begins[1:] = keys[1:] != keys[:-1]
            run = np.cumsum(begins) - 1
            different = np.bincount(run, fresh)
            if last_key is not None and not alone:
                different[0] += 2
            out = fresh & (different[run] >= 2)
            alone = different[-1] < 2
            last_key, last_node = keys[-1], nodes[-1]
            yield pd.DataFrame({"key": keys[out], "node": nodes[out]})

    rare = sets.select(F.explode("rare").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    return (rare.mapInPandas(several, "key long, node long")
            .union(sets.select(F.explode("frequent").alias("key"), "node").distinct()))


# --- the search -----------------------------------------------------------------------------------

class _Classes:
    """Union-find over a task's documents."""

    def __init__(self, labels: list):
        first: dict = {}
        self.parent = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def t_occurrence_links(keys: list[np.ndarray], labels: list, queries: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """Links (indices) that join all linked documents of different ``labels``.

    With ``queries`` None every pair counts, else the pairs that hold one of the queries.
    """
    total, classes, links = len(keys), _Classes(labels), []
    sizes = [len(k) for k in keys]
    flat, starts = np.concatenate(keys), np.cumsum([0, *sizes[:-1]])

    # Leaders: one document against all others at once. Families of near copies fall together here.
    compared, done = 0, set()
    order = sorted(queries if queries is not None else range(total), key=lambda i: -sizes[i])
    led: set[int] = set()
    for i in order:
        if compared == _LEADERS:
            break
        if classes.root(i) in led:
            continue
        compared += 1
        done.add(i)
        common = np.add.reduceat(np.isin(flat, keys[i]), starts, dtype=np.int64)
        for j in np.flatnonzero(100 * common >= percent * (np.array(sizes) + sizes[i] - common)).tolist():
            if classes.join(i, j):
                links.append((i, j))
        led = {classes.root(x) for x in [*led, i]}
    else:
        if queries is None and total <= _LEADERS and compared == total:
            return links

    roots = [classes.root(i) for i in range(total)]
    if len(set(roots)) == 1 or (queries is not None and done.issuperset(queries)):
        return links
    if queries is None:  # of any two classes one is not the largest
        values, times = np.unique(roots, return_counts=True)
        largest = values[times.argmax()]
        queries = [i for i in range(total) if roots[i] != largest]

    # Inverted lists of what at least two documents hold, as document numbers in ascending order.
    owner = np.repeat(np.arange(total), sizes)
    by_key = np.lexsort((owner, flat))
    grams, begin, times = np.unique(flat[by_key], return_index=True, return_counts=True)
    owner = owner[by_key]
    lists = {int(g): owner[b:b + t].tolist() for g, b, t in zip(grams[times > 1], begin[times > 1], times[times > 1])}
    for i in queries:
        size = sizes[i]
        need = _required(size, percent)
        found = sorted((lists[k] for k in keys[i].tolist() if k in lists), key=len)
        if len(found) < need:
            continue
        n_long = min(need - 1, int(need / (_MU * math.log2(len(found[-1])) + 1)))
        short, long_ = found[:len(found) - n_long], found[len(found) - n_long:]
        for j, run in groupby(heapq.merge(*short)):
            hits = sum(1 for _ in run)
            if hits < need - n_long or percent * max(size, sizes[j]) > 100 * min(size, sizes[j]) or classes.root(i) == classes.root(j):
                continue
            wanted, left = -(-percent * (size + sizes[j]) // (100 + percent)), n_long
            for entries in long_:
                if hits >= wanted or hits + left < wanted:
                    break
                at = bisect_left(entries, j)
                hits += at < len(entries) and entries[at] == j
                left -= 1
            if hits >= wanted and classes.join(i, j):
                links.append((i, j))
    return links


def _search(rows: DataFrame, group: list[str], percent: int) -> DataFrame:
    """(a, b) links found in each group of rows (node, label, query, keys: sorted hashes as bytes)."""
    columns = [*group, "node", "label", "query", "keys"]

    def run(batches):
        held, current = [], None

        def flush():
            keys = [np.frombuffer(r[3], np.uint64) for r in held]
            asked = [i for i, r in enumerate(held) if r[2]]
            links = t_occurrence_links(keys, [r[1] for r in held], None if len(asked) == len(held) else asked, percent)
            return pd.DataFrame({"a": [held[i][0] for i, _ in links], "b": [held[j][0] for _, j in links]}, dtype="int64")

        for batch in batches:
            for row in batch[columns].itertuples(index=False, name=None):
                name = row[:len(group)]
                if name != current and held:
                    yield flush()
                    held = []
                current = name
                held.append(row[len(group):])
        if held:
            yield flush()

    # Sorted runs instead of groupBy().applyInPandas: most groups are two or three documents.
    return rows.select(columns).repartition(*group).sortWithinPartitions(*group).mapInPandas(run, "a long, b long")


def _classes_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with label = the smallest node that the links join it with."""
    found = connected_components(links)
    return materialise(nodes.drop("label").join(found.withColumnRenamed("component", "label"), "node", "left")
                       .withColumn("label", F.coalesce("label", "node")))


def _several(named: DataFrame) -> DataFrame:
    """(cell, key, label, node, size, held): the n-grams of the rows (cell, node, label, keys) that several classes of a cell
    have; held: the number of its documents that do."""
    def spell(batches):
        for batch in batches:
            keys = [np.frombuffer(k, np.int64) for k in batch["keys"]]
            sizes = [len(k) for k in keys]
            yield pd.DataFrame({"cell": np.repeat(batch["cell"].to_numpy(), sizes), "key": np.concatenate(keys) if keys else np.empty(0, np.int64),
                                "label": np.repeat(batch["label"].to_numpy(), sizes), "node": np.repeat(batch["node"].to_numpy(), sizes),
                                "size": np.repeat(sizes, sizes).astype(np.int64)})

    of_key = Window.partitionBy("cell", "key")
    return (named.select("cell", "node", "label", "keys").mapInPandas(spell, "cell long, key long, label long, node long, size long")
            .withColumns({"low": F.min("label").over(of_key), "high": F.max("label").over(of_key), "held": F.count("*").over(of_key)})
            .where("low < high").drop("low", "high"))


def _able(named: DataFrame, percent: int) -> DataFrame:
    """The rows (cell, node, label, keys) that can have a partner of another class in their cell: of a document's n-grams
    as many as a partner must share are found in several classes."""
    counts = materialise(_several(named).groupBy("node").agg(F.count("*").alias("n")))
    release_shuffles(named.sparkSession)
    return materialise(named.join(counts, "node").where(f"100 * n >= {percent} * (length(keys) div 8)").drop("n"))


def _first_shared(named: DataFrame, percent: int) -> DataFrame:
    """(cell, key, label, node, size, rest): the first n-grams of step 6; rest: how many of the document's follow, itself included."""
    of_node = Window.partitionBy("node")
    return (_several(named).select("cell", "key", "label", "node", "size", F.count("*").over(of_node).alias("r"),
                                   F.row_number().over(of_node.orderBy("held", "key")).alias("at"))
            .where(f"at <= r - (({percent} * size + 99) div 100) + 1")
            .select("cell", "key", "label", "node", "size", (F.col("r") - F.col("at") + 1).alias("rest")))


def _measured(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs`` (center, node, size of node), each center with its partners, dealt over parts if they are large."""
    parts = pairs.groupBy("center").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("parts"))
    dealt = materialise(pairs.join(parts, "center").select("center", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node"))
    held = named.select("node", "label", "keys")
    centers = dealt.select("center", "part").distinct().withColumn("node", F.col("center"))
    columns = ["center", "part", "node", "label", "query", "keys"]
    rows = (dealt.join(held, "node").withColumn("query", F.lit(False)).select(columns)
            .union(centers.join(held, "node").withColumn("query", F.lit(True)).select(columns)))
    return _search(rows, ["center", "part"], percent)


def _against_all(named: DataFrame, percent: int) -> DataFrame:
    """Links that join all linked documents of a cell (cell, node, label, keys): what is outside its largest class, against all blocks."""
    per_class = named.groupBy("cell", "label").agg(F.count("*").alias("n"))
    largest = per_class.groupBy("cell").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
    blocks = named.groupBy("cell").agg(F.ceil(F.sum(F.length("keys") / 8) / BLOCK).cast("int").alias("blocks"))
    named = named.join(largest, "cell").join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = named.where("label <> top")
    outside = rest.groupBy("cell").agg(F.ceil(F.sum(F.length("keys") / 8) / BLOCK).cast("int").alias("parts"))
    asking = (rest.join(outside, "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("parts")).cast("int"))
              .withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    asked = (named.join(outside, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("against", F.col("block")))
    columns = ["cell", "part", "against", "node", "label", "query", "keys"]
    pairs = asking.withColumn("query", F.lit(True)).select(columns).union(asked.withColumn("query", F.lit(False)).select(columns))
    return _search(pairs, ["cell", "part", "against"], percent)


def _between_classes(named: DataFrame, percent: int) -> DataFrame:
    """Links that join all linked documents of different classes in a cell (cell, node, label, keys)."""
    spark = named.sparkSession
    first = materialise(_first_shared(named, percent))
    release_shuffles(spark)

    def can_link(size, rest, other_size, other_rest):
        """The n-gram being the first that both have, as many as a link needs must be left in both."""
        return 100 * F.least(rest, other_rest) >= percent * (size + other_size - F.least(rest, other_rest))

    # Each document and the one that is at the head of most of its first n-grams.
    heads = first.groupBy("cell", "key").agg(F.min(F.struct("node", "label", "size", "rest")).alias("head"))
    met = first.join(heads, ["cell", "key"]).where(F.col("label") != F.col("head.label")).where(
        can_link(F.col("size"), F.col("rest"), F.col("head.size"), F.col("head.rest")))
    best = (met.groupBy("node", "size", F.col("head.node").alias("center")).agg(F.count("*").alias("n"))
            .groupBy("node", "size").agg(F.max_by("center", F.struct("n", "center")).alias("center")))
    links = materialise(_measured(materialise(best), named, percent))
    release_shuffles(spark)

    # All pairs with a first n-gram in common that are still of different classes.
    a, b = (named.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}")).distinct() for x in "ab")
    joined = connected_components(links.join(a, "a").join(b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
                                  ).withColumnRenamed("node", "label")

    def renamed(rows):
        return rows.join(joined, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")

    of_key = Window.partitionBy("cell", "key")
    first = materialise(renamed(first).withColumns({"low": F.min("label").over(of_key), "high": F.max("label").over(of_key),
                                                    "n": F.count("*").over(of_key)}).where("low < high"))
    named = renamed(named)
    few = first.where(F.col("n") <= FEW).select("cell", "key", "node", "label", "size", "rest")
    other = few.select("cell", "key", *(F.col(x).alias(f"other_{x}") for x in ("node", "label", "size", "rest")))
    pairs = (few.join(other, ["cell", "key"]).where("other_node < node AND other_label <> label")
             .where(can_link(*map(F.col, ("size", "rest", "other_size", "other_rest"))))
             .select(F.col("other_node").alias("center"), "node", "size").distinct())
    links = materialise(links.union(_measured(materialise(pairs), named, percent)))
    release_shuffles(spark)
    many = first.where(F.col("n") > FEW)
    if many.isEmpty():
        return links
    leads = many.groupBy("cell", "key").agg(F.min("node").alias("b"))
    families = connected_components(many.join(leads, ["cell", "key"]).select(F.col("node").alias("a"), "b").where("a <> b").distinct())
    return links.union(_against_all(materialise(named.drop("cell").join(families.withColumnRenamed("component", "cell"), "node")), percent))


def _links_of_cells(cells: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """All links needed within the cells (node: a doc_id, size, cell)."""
    blocks = cells.groupBy("cell").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    placed = materialise(cells.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))

    def build(batches):
        hashes = _WordHashes()
        for batch in batches:
            keys = [ngram_keys(text, n, hashes) for text in batch.pop("text")]
            yield batch.assign(keys=[k.tobytes() for k in keys])

    texts = possible(docs.select(F.col("doc_id").alias("node"), "text"), "node", placed.select("node")).where("possible")
    dealt = materialise(texts.drop("possible").join(placed.hint("shuffle_hash"), "node")
                        .select("node", "cell", "block", "blocks", "text")
                        .mapInPandas(build, "node long, cell long, block int, blocks int, keys binary")
                        ).withColumns({"label": F.col("node"), "query": F.lit(True)})
    release_shuffles(docs.sparkSession)
    links = materialise(_search(dealt, ["cell", "block"], percent))
    several = dealt.where("blocks > 1")
    if several.isEmpty():
        return links

    # Hubs: a few members of every sizeable class, to join the classes of one family across blocks.
    nodes = _classes_of(several.select("node", "cell", "block", "blocks"), links)
    sizeable = nodes.groupBy("cell", "label").agg(F.count("*").alias("n")).where(F.col("n") >= _HUB_FROM)
    hub = (nodes.join(sizeable, ["cell", "label"])
           .where(F.pmod(F.xxhash64(F.lit(1), "node"), F.col("n")) < _HUB_MEMBERS)
           .select("node", "cell", "label", F.pmod(F.xxhash64("node"), F.ceil(F.col("blocks") / _HUB_MEMBERS)).alias("hub")))
    held = several.select("node", "cell", "block", "blocks", "query", "keys")
    links = materialise(links.union(_search(held.drop("cell").join(hub, "node"), ["cell", "hub"], percent)))

    # What can still be linked to another class of its cell.
    nodes = _classes_of(nodes, links)
    named = _able(materialise(held.join(nodes.select("node", "cell", "label"), ["node", "cell"]).select("cell", "node", "label", "keys")), percent)
    return links.union(_between_classes(named, percent))


# --- the join -------------------------------------------------------------------------------------

def ngram_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    sets = materialise(_sets(docs, n, percent))
    # Copies of a set are one document from here on: the one with the smallest id.
    copies = materialise(sets.where("size > 0 AND doc_id IS NOT NULL").groupBy("digest", "node", "size").agg(F.min("doc_id").alias("first")))
    shared = materialise(_shared(sets.where("doc_id IS NOT NULL")))
    release_shuffles(docs.sparkSession)
    enough = F.col("n") >= 1 + F.floor(EXTRA * F.floor((percent * F.col("size") + 99) / 100) / 100)
    partnered = materialise(copies.join(shared.groupBy("node").agg(F.count("*").alias("n")), "node").where(enough)
                            .select("node", "first", "size"))
    postings = materialise(shared.join(partnered.select("node", "first"), "node").select("key", "first"))
    leaders = postings.groupBy("key").agg(F.min("first").alias("lead"))
    stars = (postings.join(leaders, "key").where("first <> lead")
             .select(F.col("first").alias("a"), F.col("lead").alias("b")).distinct())
    cells = connected_components(stars).withColumnRenamed("component", "cell")
    release_shuffles(docs.sparkSession)
    cells = cells.join(partnered.select(F.col("first").alias("node"), "size"), "node")
    links = materialise(_links_of_cells(cells, docs, n, percent))
    classes = connected_components(links)
    release_shuffles(docs.sparkSession)
    named = copies.join(classes.withColumnRenamed("node", "first"), "first", "left").select(
        "digest", F.coalesce("component", "first").alias("component_id"))
    return sets.join(named, "digest", "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_per_class(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, and those without a doc_id."""
    gone = materialise(ngram_classes(docs, n, percent).where("doc_id <> component_id").select("doc_id").distinct())
    release_shuffles(docs.sparkSession)
    marked = possible(docs.select(F.col("doc_id").alias("__id"), F.struct(docs.columns).alias("__row")), "__id", gone)
    asked = marked.where("possible").join(gone.hint("shuffle_hash"), F.col("__id") == F.col("doc_id"), "left_anti")
    return marked.where("NOT possible").select("__row.*").union(asked.select("__row.*"))


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_classes(documents(spark, folder), n=4, percent=85)


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}

SQL = {"op2_ngram_jaccard": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS start, doc_id AS here FROM n UNION SELECT start, b FROM r JOIN l ON a = here)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT start AS doc_id, min(here) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""}
