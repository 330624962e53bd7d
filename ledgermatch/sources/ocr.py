"""OCR output (nested pages) and stored model answers to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.functions import dates, geometry, money, text

c = F.col

_WORDS = "array<struct<value:string,confidence:double,geometry:array<array<double>>>>"
_LINES = f"array<struct<geometry:array<array<double>>,confidence:double,words:{_WORDS}>>"
PAGE_SCHEMA = (f"document_id string, doc_type string, page_number int, width double, height double, "
               f"blocks array<struct<geometry:array<array<double>>,confidence:double,lines:{_LINES}>>")

# Beginnings of lines that never name a vendor.
BOILERPLATE = ("invoice", "amount", "qty", "description", "total", "date", "due", "bill to", "customer", "po box",
               "service", "payment terms", "unit price", "memo", "amt", "subtotal", "balance")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).json(path)


def _line_info(line: Column) -> Column:
    shown = F.array_join(F.transform(line["words"], lambda w: w["value"]), " ")
    return F.struct(shown.alias("text"), line["geometry"].alias("geometry"), line["geometry"][0][1].alias("y"),
                    line["confidence"].alias("confidence"))


def _with_values(info: Column) -> Column:
    return F.struct(info["text"].alias("text"), info["geometry"].alias("geometry"), info["y"].alias("y"),
                    info["confidence"].alias("confidence"), money.line_amount(info["text"]).alias("amount"),
                    dates.line_date(info["text"]).alias("date"))


def block_lines(pages: DataFrame) -> DataFrame:
    """One row per block with its lines as (text, geometry, y, confidence, amount, date)."""
    blocks = pages.select("document_id", "doc_type", "page_number", "width", "height",
                          F.posexplode("blocks").alias("block_no", "block"))
    return blocks.withColumn("lines", F.transform(F.transform(c("block")["lines"], _line_info), _with_values)).drop("block")


def nearest_date(own: Column, lines: Column) -> Column:
    """The line's own date, else the date of the nearest other line of the block; lines that say
    'Date:' go before all others (N17)."""
    others = F.filter(lines, lambda x: (x["text"] != own["text"]) & x["date"].isNotNull())
    labelled = F.filter(others, lambda x: x["text"].contains("Date:"))
    pool = F.when(F.size(labelled) > 0, labelled).otherwise(others)
    ranked = F.transform(pool, lambda x, i: F.struct(F.abs(x["y"] - own["y"]).alias("gap"), i.alias("i"), x["date"].alias("date")))
    return F.coalesce(own["date"], F.array_min(ranked)["date"])


def vendor_line(own: Column, lines: Column) -> Column:
    """The first line of the block that can name a vendor."""
    def names(x: Column) -> Column:
        t = F.btrim(x["text"], F.lit(" \t\r\n"))
        skip = F.lower(t).rlike("^(" + "|".join(BOILERPLATE) + ")")
        return ((t != "") & (t != F.btrim(own["text"], F.lit(" \t\r\n"))) & ~skip & x["amount"].isNull()
                & x["date"].isNull() & t.rlike(r"\p{L}"))

    return F.btrim(F.try_element_at(F.filter(lines, names), F.lit(1))["text"], F.lit(" \t\r\n"))


def scan_ocr_layout(pages: DataFrame) -> DataFrame:
    """One entity per line with a currency amount (S4). All context lies in the block row, so there
    is no join and no shuffle; only amount lines are exploded together with their block."""
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    hits = block_lines(pages).withColumn("_hits", F.filter(numbered, lambda h: h["line"]["amount"].isNotNull()))
    lines = hits.select("*", F.explode("_hits").alias("h")).select("*", "h.*")
    own = c("line")
    return lines.select(
        "document_id", "page_number", "block_no", "line_no", text.entity_type(c("doc_type")).alias("entity_type"),
        own["amount"].alias("amount_cents"), F.lit("USD").alias("currency"),
        nearest_date(own, c("lines")).alias("transaction_date"), vendor_line(own, c("lines")).alias("counterparty"),
        own["text"].alias("description"),
        geometry.normalise_polygon(own["geometry"], c("width"), c("height")).alias("bbox"),
        own["confidence"].alias("extraction_confidence"), F.lit("ocr").alias("source_format"))


_ANSWER = ("struct<entity_type:string,entity_subtype:string,amount_raw:string,amount_cents:string,currency:string,"
           "transaction_date:string,counterparty:string,description:string,gl_account_code:string,page_number:int,"
           "extraction_confidence:double,source_format:string>")


def model_rows_to_entities(answers: DataFrame) -> DataFrame:
    """``answers``: (document_id, answer). Objects of the salvaged array become entities with the
    defaults for what is missing; anything that is not an object is skipped (N21, N22)."""
    # Element by element: one that is no object must not spoil the others.
    items = answers.select("document_id", F.posexplode(F.from_json(text.salvage_json_array(c("answer")), "array<string>")).alias("item_no", "item"))
    i = c("i")
    objects = (items.filter(F.btrim(c("item")).startswith("{")).select("document_id", "item_no", F.from_json("item", _ANSWER).alias("i"))
               .filter(i.isNotNull()))

    def filled(name: str) -> Column:
        return F.when(i[name] != "", i[name])

    return objects.select(
        "document_id", "item_no", F.coalesce(i["entity_type"], F.lit("invoice_line_item")).alias("entity_type"),
        F.coalesce(filled("entity_subtype"), F.lit("standard")).alias("entity_subtype"),
        money.amount_verbatim(F.coalesce(filled("amount_raw"), i["amount_cents"], F.lit(""))).alias("amount_cents"),
        F.coalesce(i["currency"], F.lit("USD")).alias("currency"),
        dates.date_verbatim(i["transaction_date"]).alias("transaction_date"), i["counterparty"].alias("counterparty"),
        i["description"].alias("description"), i["gl_account_code"].alias("gl_account_code"),
        F.coalesce(i["page_number"], F.lit(1)).alias("page_number"),
        F.coalesce(i["extraction_confidence"], F.lit(1.0)).alias("extraction_confidence"),
        F.coalesce(i["source_format"], F.lit("ocr")).alias("source_format"))


def ground_citations(cited: DataFrame, lines: DataFrame) -> DataFrame:
    """``cited``: (document_id, total_cents, indices array); ``lines``: (document_id, line_no, text).

    Cited lines that carry the total stay; else the first three lines that do; else the citation as
    it was (N23). Only lines of the right amount are joined and only three per document survive.
    """
    carrying = (lines.withColumn("cents", money.amount_citation(c("text")))
                .join(cited.select("document_id", "total_cents", "indices"), "document_id")
                .filter(c("cents") == c("total_cents")))
    kept = carrying.filter(F.array_contains("indices", c("line_no"))).groupBy("document_id").agg(
        F.collect_set("line_no").alias("hits"))
    first = carrying.groupBy("document_id").agg(F.min("line_no").alias("l1"))
    second = carrying.join(first, "document_id").filter(c("line_no") > c("l1")).groupBy("document_id", "l1").agg(F.min("line_no").alias("l2"))
    third = carrying.join(second, "document_id").filter(c("line_no") > c("l2")).groupBy("document_id").agg(F.min("line_no").alias("l3"))
    leading = (first.join(second.drop("l1"), "document_id", "left").join(third, "document_id", "left")
               .select("document_id", F.array_compact(F.array("l1", "l2", "l3")).alias("leading")))
    stay = F.filter("indices", lambda x: F.array_contains(F.coalesce("hits", F.array().cast("array<int>")), x))
    return (cited.join(kept, "document_id", "left").join(leading, "document_id", "left")
            .select("document_id", F.when(F.size(stay) > 0, stay).otherwise(F.coalesce("leading", "indices")).alias("indices")))


def document_context_text(lines: DataFrame) -> DataFrame:
    """Numbered lines of each document as one text, line order kept.

    ``lines``: (document_id, line_no, text). A document's size is bounded by the upload cap.
    """
    numbered = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("document_id").agg(F.array_join(F.transform(
        numbered, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"])), "\n").alias("context"))
