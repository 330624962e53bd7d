"""From documents to token ids: reject what has no language, drop copies and near copies, mix the sources, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one reads it.

- ``language`` is a filter of texts without a letter: a document goes if its language is undetermined. How sure
  the network is decides nothing, so that no clean document goes.
- Of equal texts the largest doc_id stays; of documents whose five-word shingles are 80 percent alike, and
  whatever is linked through such documents, the smallest doc_id stays.
- ``mix`` interleaves the sources at ``TARGET_WEIGHTS`` as long as each has documents, then those that are left;
  every document takes part and the rows are written in that order. ``encode`` reads their places back from the
  written files and returns them as ``slot``, so that the mix outlives the files' order, which no reader keeps.
  No stage leaves out documents for their number.
- All stages but the last return the columns they were given, extra ones included; columns whose names
  begin with two underscores are for the stages' own use.
- Null texts go in ``language``. Null ids, languages and sources are values like any others; see the
  operators. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm import exact_dedup, langid, mixing, ngram_join, sentencepiece
from ledgermatch.llm.common import documents, materialise, scratch_path


#: Of the sources in the mix: all the same.
TARGET_WEIGHTS = mixing.EQUAL


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Learns from all labelled rows (a bounded sample of them)."""
    net = langid.fit(docs)
    if net is None:  # no labelled row: nothing could be learned, which says nothing against a text with a letter
        return docs.where(langid.has_letter(F.col("text")))
    told = langid.predict(docs, net, into=("__language", "__score"))
    return told.where(F.col("__language") != langid.UNDETERMINED).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first_copies(docs, exact_dedup.DigestIndex(spark, scratch_path(spark)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.keep_one_per_class(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix of sources."""
    return mixing.take_mix(docs, weights=TARGET_WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, whether they decode to the text, and the place in the mix from 0."""
    placed = mixing.written_places(docs, "__slot").select("doc_id", "lang", "source", "text", "__slot")
    return sentencepiece.encode_column(placed).select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"), F.col("ids_exact").alias("exact"),
        F.col("__slot").alias("slot"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: A trained network decides the first stage; SQL cannot express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
