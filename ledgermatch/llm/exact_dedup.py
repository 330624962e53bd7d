"""Exact dedup against a persistent digest index.

The index is a table of (digest, keep_id), bucketed and sorted by the digest's hash, one bucket file
per append. A batch of documents is reduced to one row per digest, anti-joined to the index by a
sort-merge join that reads the index bucket by bucket without shuffling it, and what is new is appended.

Defined results
- A null text counts as empty; all empty texts are equal. No other normalisation.
- Of equal texts in one batch the row with the largest doc_id stays; a null doc_id is smaller than any
  other and stays only if the group has none else (``keep_id`` is then null).
- A digest already in the index keeps its earlier ``keep_id``: the batch's rows with that text go.
- A batch written twice (a job started again) gets the same verdicts and adds nothing.
- Rows that repeat doc_id and text are one document: one verdict, ``group_size`` counts the rows.
- An empty batch gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgermatch.llm.common import documents, materialise, scratch_path, whole_text


class DigestIndex:
    """A digest index at ``location``, a folder that all executors share. Opened again, it goes on.

    ``buckets`` is fixed when the folder is first used; reopen with the same number.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None):
        self.spark, self.location = spark, location
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"""
            CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet
            CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'""")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append_new(self, groups: DataFrame) -> None:
        """Add the rows of ``groups`` (digest, keep_id) whose digest is not in the index yet."""
        fresh = groups.select("digest", "keep_id").join(self.rows().hint("merge"), "digest", "left_anti")
        (materialise(fresh).repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.insertInto(self.table))
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One verdict per document: doc_id, keep_id, group_size, kept, text_sha256. Appends what is new."""
    rows = materialise(docs.select("doc_id", F.unhex(F.sha2(whole_text(), 256)).alias("digest"))
                       .groupBy("doc_id", "digest").agg(F.count("*").alias("n")))
    groups = materialise(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")))
    index.append_new(groups)
    known = groups.select("digest", "group_size").join(index.rows().hint("merge"), "digest")
    # The join on the digest splits a large group of copies (skew join): both sides are plain shuffles.
    return rows.join(materialise(known), "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; of wholly repeated documents one row."""
    named = docs.withColumn("__digest", F.unhex(F.sha2(whole_text(), 256)))
    kept = exact_dedup(docs, index).where("kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest"))
    # Both need the rows of a digest together: one shuffle. What is left of a digest are repeated rows.
    staying = named.join(kept, "__digest").where(F.col("doc_id").eqNullSafe(F.col("__id")))
    repeat = F.row_number().over(Window.partitionBy("__digest").orderBy("__digest"))
    return staying.withColumn("__repeat", repeat).where("__repeat = 1").select(docs.columns)


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    index = DigestIndex(spark, scratch_path(spark))
    return exact_dedup(documents(spark, folder), index)


QUERIES = {"op6_exact_dedup": op6_exact_dedup}

SQL = {"op6_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, count(*) AS n FROM documents GROUP BY ALL)
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(sum(n) OVER g AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""}
