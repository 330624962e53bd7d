r"""Line dedup with a log-template tree of fixed depth. DataFrame functions only.

1. A line's tokens are ``[^\x20\x09-\x0D]+``; a token with a digit is a variable field, ``<*>``. Lines with
   fewer than ``MIN_TOKENS`` tokens are left alone.
2. The tree has two inner levels: token count, then the first ``DEPTH`` tokens. A leaf is reached by a
   line's (count, leading tokens).
3. In leaves that enough documents reach, a token is constant at its place if enough (document, line)
   pairs of the leaf have it there; every other token becomes ``<*>``. That gives the line's template.
4. A template recurs if enough (document, line) pairs have it and at least ``SIMILAR`` percent of its
   tokens are constant. Lines of recurring templates are dropped from all documents.

"Enough" is ``min_docs`` documents, whatever the size of the table; equal lines of a document count once.
Copies of a line are counted before anything is shuffled by leaf or token, so a line that a third of all
documents carry costs one row per task; only lines of busy leaves are ever cut into token rows, each
different line once.

Defined results
- One row per input row: doc_id, n_lines, n_dropped, and the text without the dropped lines; the other
  lines stay as they are, in order, joined by \n. A null text stays null (n_lines 0).
- Very long texts are split into lines whole; an empty table gives an empty result.
- Rows that repeat doc_id and text count as one document and get the same result.
- Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm.common import documents, materialise, row_key

MIN_TOKENS, DEPTH, SIMILAR = 6, 3, 60
MIN_DOCS = 10


def _lines(docs: DataFrame) -> DataFrame:
    """key, line, leaf, variant, masked (the tokens with single spaces between)."""
    lines = docs.select(row_key().alias("key"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    fields = r"if(raw RLIKE '[0-9]', regexp_replace(raw, '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '<*>'), raw)"
    spaced = r"trim(if(raw RLIKE '[\\x09-\\x0D]|\\x20\\x20', regexp_replace(raw, '[\\x20\\x09-\\x0D]+', ' '), raw))"
    # Unfolding a list of one keeps the optimizer from repeating the patterns for every use of the column.
    return (lines.selectExpr("key", "line", f"explode(array({fields})) AS raw")
            .selectExpr("key", "line", f"explode(array({spaced})) AS masked")
            .selectExpr("*", "if(masked = '', 0, length(masked) - length(replace(masked, ' ', '')) + 1) AS size")
            .where(F.col("size") >= MIN_TOKENS)
            .selectExpr("key", "line", "masked", f"xxhash64(size, substring_index(masked, ' ', {DEPTH})) AS leaf", "xxhash64(masked) AS variant"))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, line of every line with a recurring template."""
    lines = materialise(_lines(docs).select("key", "line", "leaf", "variant"))
    carried = lines.select("key", "leaf", "variant").distinct()
    variants = materialise(carried.groupBy("leaf", "variant").agg(F.count("*").alias("n")))
    busy = variants.groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    variants = materialise(variants.join(busy, "leaf"))
    # One copy of every different line of the busy leaves, cut into tokens.
    texts = (_lines(docs).join(variants.select("leaf", "variant"), ["leaf", "variant"], "left_semi")
             .groupBy("leaf", "variant").agg(F.first("masked").alias("masked")))
    tokens = materialise(texts.join(variants, ["leaf", "variant"])
                         .select("leaf", "variant", "n", F.posexplode(F.split("masked", " ")).alias("place", "token")))
    support = tokens.groupBy("leaf", "place", "token").agg(F.sum("n").alias("support"))
    constant = (F.col("support") >= min_docs) & (F.col("token") != "<*>")
    templates = (tokens.join(support, ["leaf", "place", "token"])
                 .groupBy("leaf", "variant").agg(
                     F.max("n").alias("n"), F.count("*").alias("size"), F.count_if(constant).alias("constants"),
                     F.sort_array(F.collect_list(F.when(constant, F.struct("place", "token")))).alias("parts"))
                 .where(100 * F.col("constants") >= SIMILAR * F.col("size"))
                 .select("leaf", "variant", "n", F.xxhash64("size", "parts").alias("template")))
    templates = materialise(templates)
    recurring = (templates.groupBy("leaf", "template").agg(F.sum("n").alias("n"))
                 .where(F.col("n") >= min_docs).select("leaf", "template"))
    gone = templates.join(recurring, ["leaf", "template"], "left_semi").select("leaf", "variant")
    return lines.join(gone, ["leaf", "variant"], "left_semi").select("key", "line")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, text of every row of ``docs``."""
    gone = (dropped_lines(docs, min_docs).distinct().groupBy("key").agg(F.sort_array(F.collect_list("line")).alias("gone")))
    # The texts are shuffled at every size: a broadcast of what goes would grow with the corpus.
    kept = docs.select("doc_id", row_key().alias("key"), "text").join(materialise(gone).hint("merge"), "key", "left")
    # The lines' places minus those that go; both lists are one document's.
    return (kept.withColumn("lines", F.split("text", "\n"))
            .withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>"))))
            .selectExpr("doc_id", "cast(if(text IS NULL, 0, size(lines)) AS bigint) AS n_lines",
                        "cast(coalesce(size(gone), 0) AS bigint) AS n_dropped",
                        r"CASE WHEN gone IS NULL THEN text ELSE array_join(transform(stay, i -> lines[i]), '\n') END AS text"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(documents(spark, folder))


QUERIES = {"op7_line_dedup": op7_line_dedup}

SQL = {"op7_line_dedup": r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text, i - 1 AS line, list_transform(regexp_extract_all(s[i], '[^\x20\x09-\x0D]+'),
             lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m
      FROM (SELECT *, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
f AS (SELECT doc_id, text, line, m, len(m) AS size, m[1:3] AS lead FROM l WHERE len(m) >= 6),
least AS (SELECT 10 AS least),
v AS (SELECT size, lead, m, count(*) AS n FROM (SELECT DISTINCT doc_id, text, size, lead, m FROM f) GROUP BY ALL),
b AS (SELECT * FROM v JOIN (SELECT size, lead FROM v, least GROUP BY ALL HAVING sum(n) >= any_value(least)) USING (size, lead)),
t AS (SELECT size, lead, m, n, unnest(range(1, size + 1)) AS i FROM b),
s AS (SELECT size, lead, i, m[i] AS token, sum(n) AS support FROM t GROUP BY ALL),
p AS (SELECT t.size, t.lead, t.m, any_value(n) AS n,
             list(CASE WHEN support >= least AND token <> '<*>' THEN token ELSE '<*>' END ORDER BY t.i) AS template,
             count(*) FILTER (support >= least AND token <> '<*>') AS constants
      FROM t JOIN s ON s.size = t.size AND s.lead = t.lead AND s.i = t.i AND s.token = t.m[t.i], least GROUP BY t.size, t.lead, t.m),
q AS (SELECT size, lead, m, n, template FROM p WHERE 100 * constants >= 60 * size),
g AS (SELECT m FROM q JOIN (SELECT size, lead, template FROM q, least GROUP BY ALL HAVING sum(n) >= any_value(least)) USING (size, lead, template)),
x AS (SELECT doc_id, text, list(line) AS gone FROM f SEMI JOIN g USING (m) GROUP BY ALL)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       CASE WHEN gone IS NULL THEN text
            ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda y, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
FROM documents LEFT JOIN x USING (doc_id, text)
"""}
