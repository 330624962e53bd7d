"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Every source's documents are dealt into blocks in hash order. A source of weight w (all weights sum to 1)
gets block i between its release floor((i - 1) / w) and its deadline ceil(i / w); each slot goes to the
released block with the earliest deadline. After any number of slots t, each source has had less than one
block more or less than w * t.

Target weights are given per source, or ``EQUAL`` for the same weight to every source; without any the sources' own
shares count, uncapped. Where a slot's source has no block left the weights cannot be held any longer: the sources
that still have blocks share the following slots by their weights among themselves, until every block
has a slot. With ``whole`` False ``mix_sources`` ends the mix there and reports the documents beyond with a null slot.
``take_mix`` gives the rows in the order of their slots.

Scale: block i's slot depends on counts alone, so the driver schedules ``max_slots`` blocks at most (the
block size grows with the corpus) from one count per source, and sends that table to the tasks. Ranks
inside a source come from hash buckets with summed offsets, as many buckets as they have rows, so a source
that holds a third of all rows is never sorted or counted in one task.

Defined results
- Null is a source like any other. Sources to which given weights assign none, or 0, are never picked.
- Rows that repeat keep their own places, in any order. An empty table gives an empty result.
- Columns called mix_block, mix_release, mix_deadline or mix_slot in the input are replaced.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgermatch.llm.common import documents, materialise, row_key

MAX_SLOTS = 1 << 16
MAX_SHARE = Fraction(1, 3)
EQUAL = "equal"  # target weights: every source the same
_MIX = ["block", "release", "deadline", "slot"]


def capped_weights(blocks: dict, max_share: Fraction = MAX_SHARE) -> dict:
    """Weights in proportion to the blocks, none above ``max_share`` (or an equal share, if that is more)."""
    share, capped = max(max_share, Fraction(1, max(1, len(blocks)))), set()
    while True:
        rest = sum(n for s, n in blocks.items() if s not in capped)
        left = 1 - share * len(capped)
        over = {s for s, n in blocks.items() if s not in capped and n * left > share * rest}
        if not over:
            return {s: share if s in capped else left * n / Fraction(rest) for s, n in blocks.items()}
        capped |= over


def pfair_schedule(weights: dict, blocks: dict) -> list[tuple]:
    """(source, block, release, deadline, slot), blocks from 1, until a slot's source has no block left."""
    weights = {s: Fraction(w) for s, w in weights.items() if w > 0 and s in blocks}
    total = sum(weights.values())
    weights = {s: w / total for s, w in weights.items()}
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    later = [(0, k, 1) for k in range(len(names))]       # (release, source, block)
    ready: list[tuple[int, int, int, int]] = []          # (deadline, source, block, release)
    found, slot = [], 0
    while later or ready:
        while later and later[0][0] <= slot:
            release, k, block = heapq.heappop(later)
            w = weights[names[k]]
            heapq.heappush(ready, (-(-block * w.denominator // w.numerator), k, block, release))
        deadline, k, block, release = heapq.heappop(ready)
        if block > blocks[names[k]]:
            break
        found.append((names[k], block, release, deadline, slot))
        w = weights[names[k]]
        heapq.heappush(later, (block * w.denominator // w.numerator, k, block + 1))
        slot += 1
    return found


def whole_schedule(weights: dict, blocks: dict) -> list[tuple]:
    """``pfair_schedule`` and, from where it ends, the same for the blocks left; every block of a weighted source once.

    Inside each part a source has less than one block more or less than its weight among the part's sources.
    """
    used, found = dict.fromkeys(blocks, 0), []
    while True:
        left = {s: n - used[s] for s, n in blocks.items() if n > used[s] and weights.get(s, 0) > 0}
        if not left:
            return found
        start = len(found)
        found += [(s, used[s] + block, start + release, start + deadline, start + slot)
                  for s, block, release, deadline, slot in pfair_schedule({s: weights[s] for s in left}, left)]
        for s, *_ in found[start:]:
            used[s] += 1


def _source_key(source):
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def mix_sources(docs: DataFrame, weights: dict | str | None = None, max_share: Fraction | None = None,
                max_slots: int = MAX_SLOTS, source: str = "source", prefix: str = "mix_", whole: bool = True) -> DataFrame:
    """``docs`` with mix_block, mix_release, mix_deadline (in slots) and mix_slot; all but the block null where not in the mix.

    Without ``weights`` (source -> weight, or ``EQUAL``) the sources' own shares count, none above ``max_share`` if that is given.
    ``whole``: where the weights cannot be held any longer the blocks left are mixed too, none is left out.
    """
    spark = docs.sparkSession
    mix = [prefix + x for x in _MIX]
    kept = [F.col(f"row.`{name}`") for name in docs.columns if name not in mix]
    sizes = {r[0]: r[1] for r in docs.groupBy(source).count().collect()}  # one row per source
    block_rows = max(1, -(-sum(sizes.values()) // max_slots))
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    chosen = dict.fromkeys(blocks, 1) if weights == EQUAL else weights if weights is not None else capped_weights(blocks, max_share) if max_share is not None else blocks
    shape = T.StructType([T.StructField("__source", T.StringType()), *(T.StructField(x, T.LongType()) for x in mix)])
    slots = (whole_schedule if whole else pfair_schedule)(chosen, blocks) if blocks else []
    plan = spark.createDataFrame([("" if s is None else f"={s}", *rest) for s, *rest in slots], shape)

    buckets = 1 + math.isqrt(max(sizes.values(), default=0))
    rows = docs.select(F.struct("*").alias("row"), _source_key(F.col(source)).alias("__source"), row_key().alias("__place"))
    rows = rows.withColumn("__bucket", F.pmod("__place", F.lit(buckets)).cast("int"))
    before = (rows.groupBy("__source", "__bucket").agg(F.count("*").alias("n"))
              .withColumn("__before", F.sum("n").over(Window.partitionBy("__source").orderBy("__bucket")) - F.col("n")).drop("n"))
    inside = F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__place"))
    ranked = (rows.withColumn("__inside", inside).join(before, ["__source", "__bucket"])
              .withColumn(mix[0], F.floor((F.col("__before") + F.col("__inside") - 1) / block_rows).cast("long") + 1))
    # The plan has at most max_slots rows and one per source; Spark broadcasts it if that is small.
    return ranked.join(plan, ["__source", mix[0]], "left").select(*kept, *mix)


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, all columns as they were: all but those whose source given weights
    assign none. Written, each file holds a run of slots, and the files follow each other."""
    mixed = mix_sources(docs, prefix="__mix_", **options).where("__mix_slot IS NOT NULL")
    return mixed.repartitionByRange("__mix_slot").sortWithinPartitions("__mix_slot").select(docs.columns)


def written_places(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their place from 0 in the order they were written in: the files' by number, a file's rows as they stand.

    Reading deals files to tasks by size, so the rows' order is lost there; a file's name and its rows' numbers are not.
    Rows that were not just read from files are written first.
    """
    where = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    try:
        numbered = rows.select("*", *where)
    except AnalysisException:
        rows = materialise(rows)
        numbered = rows.select("*", *where)
    part = F.regexp_extract("__file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    sizes = numbered.groupBy("__file").agg((F.max("__row") + 1).alias("__n"))  # one row per file
    offsets = materialise(sizes.select("__file", (F.sum("__n").over(Window.orderBy(part, "__file")) - F.col("__n")).alias("__before")))
    return numbered.join(offsets, "__file").select(*rows.columns, (F.col("__before") + F.col("__row")).alias(name))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's block and slot where all sources have the same target weight."""
    return mix_sources(documents(spark, folder), EQUAL).select("doc_id", "source", *("mix_" + x for x in _MIX))


QUERIES = {"op8_mixing": op8_mixing}
SQL: dict[str, str] = {}
