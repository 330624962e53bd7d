"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.session import materialise, scratch_path

__all__ = ["documents", "whole_text", "row_key", "crc_fold", "materialise", "scratch_path", "release_shuffles", "possible"]

WORD = r"[^\x20\x09-\x0D]+"  # fixed by the result contract


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a document by its id and content, so that an id used twice does not mix two texts."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def crc_fold(folds: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def release_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of finished steps go. Spark keeps them until the driver's plan objects are
    collected, which on an idle driver can take longer than a whole job; what follows reads written tables."""
    for _ in range(2):  # the first round only drops Python's hold on the plans
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def possible(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` with a boolean column ``possible``: false only where ``column`` is surely not among the ids (one column, long,
    a written table). About one other row in 16 is marked as well, so that a join of texts with few ids shuffles few texts.

    A bitmap of 16 bits an id says it; every task gets the bitmap, two bytes an id.
    """
    bits = max(1, ids.count()) * 16
    position = lambda x: F.pmod(F.xxhash64(x), F.lit(bits)) + 1
    bitmaps = materialise(ids.select(position(ids.columns[0]).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket"))
                          .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bitmap")))
    at = F.bitmap_bit_position(position(column))
    byte = F.conv(F.hex(F.substring("__bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return (rows.withColumn("__of", F.bitmap_bucket_number(position(column)))
            .join(F.broadcast(bitmaps), F.col("__of") == F.col("__bucket"), "left")
            .withColumn("possible", F.col(column).isNotNull() & marked).drop("__of", "__bucket", "__bitmap"))
