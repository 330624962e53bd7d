r"""Quality rules with adaptive thresholds. DataFrame functions only.

Each document gets integer measures (per thousand words or lines). Their distribution per language and
source is kept as a mergeable quantile sketch: counts per value rounded down to six significant bits, so
a quantile is at most 1/32 too low, sketches add up by summing counts, and a group's sketch has at most a
few hundred rows however large the group. The thresholds of a group are fences around its median:

    median - reach * max(median - q25, least) ... median + reach * max(q75 - median, least)

with ``least`` a measure's smallest meaningful spread. A group with fewer than ``min_rows`` documents uses
its language's merged sketch, and if that is small too, the merged sketch of all documents. The thresholds
are joined to the documents' measures; texts take no part in any shuffle.

Defined results
- Words are ``[^\x20\x09-\x0D]+``; a null text has none. A document fails the base rule with fewer than
  50 words, or with more than half of its words in repeated three-word windows.
- Null languages and sources form groups of their own.
- Only documents that pass the base rule enter the sketches; with no such document there are no
  thresholds and nothing is kept.
- Equal rows get equal verdicts. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm.common import documents, materialise

#: Smallest spread that counts, per measure (see ``measures``).
LEAST = {"mean_word": 200, "symbols": 20, "dup_lines": 50, "repeats": 40}
REACH = 8
MIN_ROWS = 200


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, <measures>."""
    words = (docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
             .selectExpr("*", r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x != '') AS w",
                         r"filter(split(text, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]') AS l")
             .selectExpr("doc_id", "lang", "source", "size(w) AS n", "size(l) AS n_lines", "size(array_distinct(l)) AS n_distinct", "w",
                         r"length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '')) AS word_chars",
                         "length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols"))
    # The windows by hash and place; equal windows then stand side by side.
    windows = words.selectExpr("*", """sort_array(transform(if(n >= 3, sequence(0, n - 3), cast(array() AS array<int>)),
                                       i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i))) AS s""").drop("w")
    repeated = windows.selectExpr("*", """sort_array(transform(filter(s, (x, j) ->
        (j > 0 AND s[greatest(j - 1, 0)].h = x.h) OR (j < n - 3 AND s[least(j + 1, n - 3)].h = x.h)), x -> x.i)) AS p""").drop("s")
    counted = repeated.selectExpr(
        "doc_id", "lang", "source", "cast(n AS bigint) AS n_words", "cast(word_chars AS bigint) AS word_chars",
        "cast(n_symbols AS bigint) AS n_symbols", "cast(n_lines AS bigint) AS n_lines",
        "cast(n_lines - n_distinct AS bigint) AS n_dup_lines",
        """aggregate(p, struct(0L AS n, -3 AS last), (a, x) -> struct(a.n + least(3, x - a.last) AS n, x AS last)).n AS n_repeat_words""")
    return counted.selectExpr(
        "*", "n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed",
        "1000 * word_chars DIV greatest(n_words, 1) AS mean_word", "1000 * n_symbols DIV greatest(n_words, 1) AS symbols",
        "1000 * n_dup_lines DIV greatest(n_lines, 1) AS dup_lines", "1000 * n_repeat_words DIV greatest(n_words, 1) AS repeats")


def sketch(measured: DataFrame, names: list[str]) -> DataFrame:
    """lang, source, measure, value (six significant bits), n. Sketches of several inputs add up in ``merge``."""
    value = F.col("m.value")
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    rounded = F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)
    return (measured.select("lang", "source", F.explode(F.array(*(
                F.struct(F.lit(x).alias("measure"), F.col(x).alias("value")) for x in names))).alias("m"))
            .groupBy("lang", "source", F.col("m.measure").alias("measure"), rounded.alias("value"))
            .agg(F.count("*").alias("n")))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One sketch per group of ``by``; with fewer columns than the sketches have, coarser groups."""
    return sketches.groupBy(*by, "measure", "value").agg(F.sum("n").alias("n"))


def fences(merged: DataFrame, by: list[str], least: dict[str, int], reach: int) -> DataFrame:
    """``by``, measure, rows, low, high of every group."""
    group = ", ".join([*by, "measure"])
    spread = F.create_map(*(F.lit(x) for item in least.items() for x in item))[F.col("measure")]
    running = merged.selectExpr("*", f"sum(n) OVER (PARTITION BY {group} ORDER BY value) AS upto",
                                f"sum(n) OVER (PARTITION BY {group}) AS total")
    quartile = [F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("value"))).alias(f"q{q}") for q in (1, 2, 3)]
    found = running.groupBy(*by, "measure").agg(F.max("total").alias("rows"), *quartile)
    return found.select(*by, "measure", "rows",
                        (F.col("q2") - reach * F.greatest(F.col("q2") - F.col("q1"), spread)).alias("low"),
                        (F.col("q2") + reach * F.greatest(F.col("q3") - F.col("q2"), spread)).alias("high"))


def thresholds(sketches: DataFrame, least: dict[str, int], reach: int, min_rows: int) -> DataFrame:
    """lang, source and low_<measure>, high_<measure> for every group of the sketches."""
    own = fences(merge(sketches, ["lang", "source"]), ["lang", "source"], least, reach)
    tongue = fences(merge(sketches, ["lang"]), ["lang"], least, reach)
    whole = fences(merge(sketches, []), [], least, reach)
    a, b, c = own.alias("a"), tongue.alias("b"), whole.alias("c")
    joined = (a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.measure") == F.col("b.measure")))
              .join(c, F.col("a.measure") == F.col("c.measure")))
    chosen = {x: F.when(F.col("a.rows") >= min_rows, F.col(f"a.{x}")).when(F.col("b.rows") >= min_rows, F.col(f"b.{x}"))
              .otherwise(F.col(f"c.{x}")) for x in ("low", "high")}
    return (joined.select("a.lang", "a.source", "a.measure", chosen["low"].alias("low"), chosen["high"].alias("high"))
            .groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{x}_{m}")
                                             for m in least for x in ("low", "high"))))


def quality_rules(docs: DataFrame, least: dict[str, int] | None = None, reach: int = REACH, min_rows: int = MIN_ROWS) -> DataFrame:
    """One verdict per row of ``docs``: the measures, base_failed, the group's thresholds and ``kept``."""
    least = least or LEAST
    measured = materialise(measures(docs))
    limits = thresholds(materialise(sketch(measured.where("NOT base_failed"), list(least))), least, reach, min_rows)
    m, t = measured.alias("m"), limits.alias("t")
    inside = F.lit(True)
    for x in least:
        inside = inside & F.col(f"m.{x}").between(F.col(f"t.low_{x}"), F.col(f"t.high_{x}"))
    return (m.join(t, F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")), "left")
            .select("m.*", *(f"t.{x}_{n}" for n in least for x in ("low", "high")),
                    (~F.col("m.base_failed") & F.coalesce(inside, F.lit(False))).alias("kept")))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_quality": op9_quality}

SQL = {"op9_quality": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cover USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             1000 * word_chars // greatest(n_words, 1) AS mean_word, 1000 * n_symbols // greatest(n_words, 1) AS symbols,
             1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM m),
u AS (SELECT lang, source, measure, value FROM f UNPIVOT (value FOR measure IN (mean_word, symbols, dup_lines, repeats)) WHERE NOT base_failed),
s AS (SELECT coalesce(lang, '?null') AS g1, coalesce(source, '?null') AS g2, measure,
             (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS value FROM u),
q AS (SELECT g1, g2, measure, count(*) AS n, quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.5) AS q2, quantile_disc(value, 0.75) AS q3
      FROM s GROUP BY GROUPING SETS ((g1, g2, measure), (g1, measure), (measure))),
z AS (SELECT g1, g2, measure, n,
             q2 - 8 * greatest(q2 - q1, least) AS low, q2 + 8 * greatest(q3 - q2, least) AS high
      FROM q JOIN (VALUES ('mean_word', 200), ('symbols', 20), ('dup_lines', 50), ('repeats', 40)) v(measure, least) USING (measure)),
lim AS (SELECT a.g1, a.g2, a.measure, CASE WHEN a.n >= 200 THEN a.low WHEN b.n >= 200 THEN b.low ELSE c.low END AS low,
               CASE WHEN a.n >= 200 THEN a.high WHEN b.n >= 200 THEN b.high ELSE c.high END AS high
        FROM z a JOIN z b ON b.g2 IS NULL AND b.g1 = a.g1 AND b.measure = a.measure
        JOIN z c ON c.g1 IS NULL AND c.measure = a.measure WHERE a.g2 IS NOT NULL),
wide AS (SELECT g1, g2, max(low) FILTER (measure = 'mean_word') AS l1, max(high) FILTER (measure = 'mean_word') AS h1,
                max(low) FILTER (measure = 'symbols') AS l2, max(high) FILTER (measure = 'symbols') AS h2,
                max(low) FILTER (measure = 'dup_lines') AS l3, max(high) FILTER (measure = 'dup_lines') AS h3,
                max(low) FILTER (measure = 'repeats') AS l4, max(high) FILTER (measure = 'repeats') AS h4 FROM lim GROUP BY g1, g2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(mean_word BETWEEN l1 AND h1 AND symbols BETWEEN l2 AND h2
                                    AND dup_lines BETWEEN l3 AND h3 AND repeats BETWEEN l4 AND h4, false) AS kept
FROM f LEFT JOIN wide ON g1 = coalesce(lang, '?null') AND g2 = coalesce(source, '?null')
"""}
