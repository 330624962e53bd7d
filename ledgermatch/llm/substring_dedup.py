"""Substring dedup by content-defined chunking with a gear rolling hash.

1. The gear hash of a byte depends on the 16 bytes up to it: each step shifts the hash by a bit and adds the
   byte's table value. A chunk ends where four bits of the hash are zero, unless another such place lies in
   the ``MIN_CHUNK`` bytes before; both depend on nearby bytes only, so chunks fall back into step right
   after an insertion. Of ``WINDOW`` words without such a place the one with the smallest hash begins a chunk (the
   last of equals), so that any passage of 50 words holds a whole chunk that is cut alike wherever the passage is:
   its first 14 words decide about places, 36 are two windows. A chunk longer than ``MAX_CHUNK`` is cut from its beginning.
2. Chunks with equal digest are copies of each other. Neighbouring chunks that all have copies in other documents
   form a stretch. What a passage can hold beyond its stretch is less than a chunk behind it and, before it,
   what lies after the last place of step 1, at either side a window more if a window chose that place; stretches that cannot reach ``min_words`` words with that are
   chance and go.
3. The chunks that are left, and every sequence of them that holds ``min_words`` words, name the place of their first
   copy: that in the smallest doc_id. Copies at the same distance from there are one run. Both texts are compared
   byte by byte beyond a run's two ends: ``CONTEXT`` bytes, and ``WIDER`` times more in each further round for
   the runs that were equal throughout. So a run's bytes are a passage of one source, as long as it goes.
4. A run is cut down to whole words; with ``min_words`` words or more it is a span.

The document whose text is first keeps it; the others lose their spans. A passage is measured against the
first documents of its chunks and sequences only. So of words that a later document shares beyond the first one, an
edge can stay: fewer than ``min_words`` words and two chunks.

Defined results
- One row per input row: doc_id, n_bytes, spans (begin, end: byte offsets; words; first_doc_id; removed),
  removed_bytes, and the remaining text. Spans are reported for the keeping document as well (removed false).
  Spans of different sources may overlap; one that lies inside another is not reported.
- A null text has no spans and stays null; an empty one stays empty. Very long texts are cut whole.
- Documents are told apart by doc_id: rows that share one, whether their texts are equal or not, remove nothing
  from each other, and text that repeats within one document only is not touched. Where a stretch holds the same
  chunk often, as in a text that says one word all over, its first and last occurrence are looked at, and every
  occurrence of a sequence of chunks that holds ``min_words`` words.
- A null doc_id counts as larger than any other; rows without one remove nothing from each other.
- Other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import documents, materialise, row_key

MIN_CHUNK, MAX_CHUNK = 12, 80
MIN_WORDS = 50
WINDOW = 17  # words
CONTEXT, WIDER = 128, 16
_ONCE, _FOLLOWED = 1, 2  # a run's ``open``: compared beyond its ends in one round, or as long as the bytes are equal; 0: done
_NEARBY = MIN_CHUNK + 16  # bytes before a place that decide whether a chunk ends there
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256).astype(np.uint16)
_MASK = np.uint16(0xF000)  # the bits that all 16 bytes of the window have reached
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The hash at every byte, over the window of up to 16 bytes that ends there; doubled four times."""
    h = _GEAR[data]
    for reach in (1, 2, 4, 8):
        h[reach:] = h[reach:] + (h[:-reach] << np.uint16(reach))
    return h


def places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin after the first, with the byte from which on a passage must reach for its copies to agree on
    that; negative places are those that a window of words chose."""
    n, hashes = len(data), gear_hash(data)
    found = np.flatnonzero((hashes & _MASK) == 0) + 1
    found = found[found < n]
    found = found[(data[found] & 0xC0) != 0x80]
    found = found[np.diff(found, prepend=-MIN_CHUNK) >= MIN_CHUNK]
    begins = np.flatnonzero(~_SPACE[data[1:]] & _SPACE[data[:-1]]) + 1
    picked = begins[:0]
    if len(begins) >= WINDOW:
        last = begins[WINDOW - 1:]
        bare = np.flatnonzero(np.searchsorted(found, last, "right") == np.searchsorted(found, begins[:len(last)], "left"))
        windows = np.lib.stride_tricks.sliding_window_view(hashes[begins - 1], WINDOW)[:, ::-1]
        parts = [bare[at:at + 100_000] for at in range(0, len(bare), 100_000)]
        picked = np.unique(np.concatenate([p + WINDOW - 1 - windows[p].argmin(1) for p in parts])) if parts else bare
    at = np.concatenate([found, begins[picked]])
    since = np.concatenate([found, begins[np.maximum(picked - WINDOW + 1, 0)]]) - _NEARBY
    order = np.argsort(at)  # the two kinds never meet: a window with a place of the hash chooses nothing
    return np.concatenate([found, -begins[picked]])[order], np.maximum(since[order], 0)


def cut(data: np.ndarray, signed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the chunks of a text's bytes, never within a character; those of them that the bytes nearby chose."""
    n, chosen = len(data), np.abs(places(data)[0] if signed is None else signed)
    ends = np.append(chosen, n)
    wide = np.flatnonzero(np.diff(ends, prepend=0) > MAX_CHUNK)
    if len(wide):
        more = []
        for i in wide:
            at, stop = int(ends[i - 1]) if i else 0, int(ends[i])
            while stop - at > MAX_CHUNK:
                at += MAX_CHUNK
                while data[at] & 0xC0 == 0x80:
                    at -= 1
                more.append(at)
        ends = np.sort(np.append(ends, more))
    return ends, chosen


def chunk_digests(docs: DataFrame) -> DataFrame:
    """One row per document's different chunk: doc_id, digest."""
    def run(batches):
        for batch in batches:
            counts, digests = [], []
            for text in batch.column(1):
                text = text.as_py()
                raw = text.encode() if text else b""
                at, found = 0, set()
                for end in cut(np.frombuffer(raw, np.uint8))[0].tolist() if raw else ():
                    found.add(xxhash.xxh3_64_intdigest(raw[at:end]))
                    at = end
                counts.append(len(found))
                digests += found
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.array(digests, np.uint64).view(np.int64))], names=["doc_id", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest long")


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: doc_id, key, start, size (bytes), words (begun in it), before (words that a passage can hold
    before it if the chunk is the first in step), behind (words of the next chunk), digest."""
    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            counts, digests = [], []
            columns = [[] for _ in range(5)]
            for text in batch.column(2):
                text = text.as_py()
                raw = text.encode() if text else b""
                if not raw:
                    counts.append(0)
                    continue
                data = np.frombuffer(raw, np.uint8)
                signed, since = places(data)
                ends, chosen = cut(data, signed)
                begins = np.concatenate([[0], ends[:-1]])
                space = _SPACE[data]
                begun = ~space
                begun[1:] &= space[:-1]
                so_far = np.concatenate([[0], np.cumsum(begun)])
                words = so_far[ends] - so_far[begins]
                before = so_far[begins] - so_far[np.concatenate([[0], since])[np.searchsorted(chosen, begins)]] + 1
                behind = words + WINDOW * np.isin(ends, -signed)
                for column, values in zip(columns, (begins, ends - begins, words, before, np.append(behind[1:], 0))):
                    column.append(values)
                digests += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                counts.append(len(ends))
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            flat = [pa.array(np.concatenate(c).astype(np.int32) if c else np.empty(0, np.int32)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), keys.take(at), *flat, pa.array(np.array(digests, np.uint64).view(np.int64))],
                names=["doc_id", "key", "start", "size", "words", "before", "behind", "digest"])

    return (docs.select("doc_id", row_key().alias("key"), "text")
            .mapInArrow(run, "doc_id long, key long, start int, size int, words int, before int, behind int, digest long"))


def anchors(docs: DataFrame, min_words: int) -> DataFrame:
    """key, first_doc_id, first_key, shift (of the place against the first text's), begin, end, open.
    The chunks are cut twice: that is cheaper than keeping them."""
    repeated = (chunk_digests(docs).groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
                                                   F.max(F.col("doc_id").isNull().cast("int")).alias("nameless"))
                .where("least < most OR nameless = 1 AND least IS NOT NULL").select("digest"))
    # A passage in very many documents makes its digest a hot key: the join's skewed partitions are split.
    marked = chunks(docs).join(repeated, "digest").withColumn("end", F.col("start") + F.col("size")).drop("size")
    place, stretch = Window.partitionBy("key").orderBy("start"), Window.partitionBy("key", "stretch")
    starts = F.coalesce(F.lag("end").over(place) != F.col("start"), F.lit(True))
    ends = F.coalesce(F.lead("start").over(place) != F.col("end"), F.lit(True))
    reach = F.col("words") + F.when(F.col("starts"), F.col("before")).otherwise(0) + F.when(F.col("ends"), F.col("behind")).otherwise(0)
    # The words that follow a chunk in its stretch, up to the chunk that makes them min_words.
    following = stretch.orderBy("so_far").rangeBetween(0, min_words - 1)
    hopeful = (marked.distinct().withColumns({"starts": starts, "ends": ends})  # rows that repeat bring their chunks again
               .withColumn("stretch", F.sum(F.col("starts").cast("int")).over(place))
               .withColumns({"reach": F.sum(reach).over(stretch), "total": F.sum("words").over(stretch)}).where(F.col("reach") >= min_words)
               .withColumn("so_far", F.sum("words").over(stretch.orderBy("start")) - F.col("words"))
               .withColumns({"gram": F.when(F.col("total") - F.col("so_far") >= min_words, F.xxhash64(F.collect_list("digest").over(following))),
                             "gram_end": F.max("end").over(following)}))
    # Of equal chunks in a stretch the first and the last, of equal sequences all: those between are long enough to be
    # passages by themselves and are not followed beyond their last words. Windows by key are still in place here.
    for digest in ("digest", "gram"):
        same = Window.partitionBy("key", "stretch", digest)
        outer = (F.col("start") == F.min("start").over(same)) | (F.col("start") == F.max("start").over(same))
        hopeful = hopeful.withColumn(f"{digest}_outer", outer)
    hopeful = materialise(hopeful.select(
        "key", "doc_id", "start", "end", "gram_end", F.when(F.col("digest_outer"), F.col("digest")).alias("digest"),
        "gram", F.when(F.col("gram_outer"), _FOLLOWED).otherwise(_ONCE).alias("gram_open")).where("digest IS NOT NULL OR gram IS NOT NULL"))
    rows = (hopeful.select("digest", "key", "doc_id", "start", "end", F.lit(_FOLLOWED).alias("open"))
            .union(hopeful.select("gram", "key", "doc_id", "start", "gram_end", "gram_open"))).where("digest IS NOT NULL")
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "key", "start")).alias("first"))
    return (rows.join(firsts, "digest").where("doc_id IS NULL OR doc_id <> first.doc_id")
            .select("key", F.col("first.doc_id").alias("first_doc_id"), F.col("first.key").alias("first_key"),
                    (F.col("start") - F.col("first.start")).alias("shift"), F.col("start").alias("begin"), "end", "open"))


_RUN = ["key", "first_doc_id", "first_key", "shift"]


def join_up(runs: DataFrame) -> DataFrame:
    """Runs of the same texts and shift that touch or overlap, as one."""
    order = Window.partitionBy(*_RUN).orderBy("begin")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (runs.withColumn("apart", F.coalesce(F.col("begin") > reached, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("apart").over(order))
            .groupBy(*_RUN, "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.max("open").alias("open")).drop("run"))


def extend(runs: DataFrame, docs: DataFrame, context: int) -> DataFrame:
    """The runs with the equal bytes beyond both ends; those to be followed stay open if ``context`` bytes were equal."""
    edges = runs.select(*_RUN, "begin", "end", "open", F.explode(F.array(F.lit(True), F.lit(False))).alias("left")).withColumn(
        "at", F.when(F.col("left"), F.col("begin")).otherwise(F.col("end"))).withColumn("first_at", F.col("at") - F.col("shift"))
    edges = materialise(edges)
    asked = (edges.select("key", "at", "left").union(edges.select("first_key", "first_at", "left")).distinct()
             .groupBy("key").agg(F.collect_list(F.struct("at", "left")).alias("asked")))  # at most two a byte of the text
    found = (docs.select(row_key().alias("key"), F.col("text").cast("binary").alias("raw")).join(asked, "key")
             .select("key", "raw", F.explode("asked").alias("edge")).select("key", "edge.at", "edge.left", F.expr(
                 f"CASE WHEN edge.left THEN substring(raw, greatest(edge.at - {context}, 0) + 1, least({context}, edge.at)) "
                 f"ELSE substring(raw, edge.at + 1, {context}) END AS bytes")))
    around = materialise(found.groupBy("key", "at", "left").agg(F.first("bytes").alias("bytes")))  # rows that repeat bring them again

    def equal(batches):
        for batch in batches:
            lengths = []
            for left, a, b in zip(*(c.to_pylist() for c in batch.columns[-3:])):
                n = min(len(a), len(b))
                x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                differ = x[::-1][:n] != y[::-1][:n] if left else x[:n] != y[:n]
                lengths.append(int(differ.argmax()) if differ.any() else n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(lengths, pa.int32())], names=[*batch.schema.names[:-2], "more"])

    theirs = around.select(F.col("key").alias("first_key"), F.col("at").alias("first_at"), "left", F.col("bytes").alias("other"))
    both = (edges.join(around, ["key", "at", "left"]).join(theirs, ["first_key", "first_at", "left"])
            .select(*_RUN, "begin", "end", "open", "left", "bytes", "other")
            .mapInArrow(equal, "key long, first_doc_id long, first_key long, shift int, begin int, end int, open int, left boolean, more int"))
    by_side = lambda left: F.max(F.when(F.col("left") == left, F.col("more")))
    further = F.when((F.col("open") == _FOLLOWED) & (F.greatest("l", "r") >= context), _FOLLOWED).otherwise(0)
    return both.groupBy(*_RUN, "begin", "end", "open").agg(by_side(True).alias("l"), by_side(False).alias("r")).select(
        *_RUN, (F.col("begin") - F.col("l")).alias("begin"), (F.col("end") + F.col("r")).alias("end"), further.alias("open"))


def equal_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The runs of all documents, as long as their texts are equal."""
    runs = materialise(join_up(anchors(docs, min_words)))
    context = CONTEXT
    while not (still := runs.where("open > 0")).isEmpty():
        runs = materialise(join_up(extend(still, docs, context).unionByName(runs.where("open = 0"))))
        context *= WIDER
    return runs


_SPANS = "array<struct<begin:int,end:int,words:int,first_doc_id:long,removed:boolean>>"


def candidates(runs: DataFrame) -> DataFrame:
    """key, candidates: of every text the runs that lie in no other, those it keeps apart from those it loses."""
    both = runs.select("key", "begin", "end", "first_doc_id", F.lit(True).alias("removed")).union(
        runs.select("first_key", F.col("begin") - F.col("shift"), F.col("end") - F.col("shift"), "first_doc_id", F.lit(False)))
    # One row per text and beginning before anything is sorted: a first text can be that of very many runs.
    longest = both.groupBy("key", "removed", "begin").agg(F.max_by("first_doc_id", "end").alias("first_doc_id"), F.max("end").alias("end"))
    reached = F.max("end").over(Window.partitionBy("key", "removed").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    return (longest.withColumn("reached", reached).where("reached IS NULL OR end > reached")
            .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "first_doc_id", "removed"))).alias("candidates")))


def whole_words(raw: bytes, runs: list[dict], min_words: int) -> list[dict]:
    """The runs cut down to whole words, those with enough of them."""
    data = np.frombuffer(raw, np.uint8)
    wordy = ~_SPACE[data]
    turns = np.diff(np.concatenate([[False], wordy, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    spans = []
    for r in runs:
        a, b = int(np.searchsorted(begins, r["begin"])), int(np.searchsorted(ends, r["end"], "right"))
        if b - a >= min_words and b > a:
            spans.append({"begin": 0 if r["begin"] == 0 else int(begins[a]), "end": len(raw) if r["end"] == len(raw) else int(ends[b - 1]),
                          "words": b - a, "first_doc_id": r["first_doc_id"], "removed": r["removed"]})
    return spans


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_bytes, spans, removed_bytes, text: what stays of every row of ``docs``."""
    found = materialise(candidates(equal_runs(docs, min_words)))
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("words", pa.int32()),
                               ("first_doc_id", pa.int64()), ("removed", pa.bool_())]))

    def shorten(batches):
        for batch in batches:
            left, gone, spans = [], [], []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = text.encode() if runs else b""
                spans.append(whole_words(raw, runs, min_words) if runs else [])
                at, parts = 0, []
                for s in spans[-1]:
                    if s["removed"]:
                        parts.append(raw[at:s["begin"]])  # nothing where spans overlap
                        at = max(at, s["end"])
                rest = b"".join([*parts, raw[at:]])
                gone.append(len(raw) - len(rest))
                left.append(rest.decode() if parts else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(gone, pa.int64()), pa.array(left, pa.string())],
                names=["doc_id", "n_bytes", "spans", "removed_bytes", "text"])

    rows = docs.select("doc_id", row_key().alias("key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return (rows.join(found, "key", "left").select("doc_id", "n_bytes", "text", "candidates")
            .mapInArrow(shorten, f"doc_id long, n_bytes long, spans {_SPANS}, removed_bytes long, text string"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_substrings(documents(spark, folder))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
SQL: dict[str, str] = {}
