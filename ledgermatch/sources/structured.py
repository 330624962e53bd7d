"""CSV exports, sheet cells and OFX statements to entity rows.

Input is a table of documents (document_id, client_book_id, doc_type, content ...), read from files with
``read_documents``. One file is one row (files spread over tasks, and their lines become rows before
anything is compared); ``register_documents`` refuses files above a size and says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.functions import dates, money, text
from ledgermatch.functions.text import strip

c = F.col

# A quote is a quote at the beginning of a field only; anywhere else it is a character.
_QUOTED = r'"(?:[^"]++|"")*+"[^,\r\n]*+'
_RECORD = rf'(?=[^\r\n])(?:{_QUOTED}|[^,\r\n]*+)(?:,(?:{_QUOTED}|[^,\r\n]*+))*+'
_FIELD = r',("(?:[^"]++|"")*+"[^,]*+|[^,]*+)'

# Columns of double-entry exports that hold an amount, in order of preference.
SIDES = ("Debit", "Credit", "debit", "credit", "debit_amount", "credit_amount")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, length, content). Nothing is decoded on the driver."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "length", "content"))


def csv_fields(record: Column) -> Column:
    """Fields of one record; quotes are removed and doubled quotes undone."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(1))
    return F.transform(raw, lambda f: F.when(
        f.startswith('"'), F.regexp_replace(F.regexp_replace(f, '^"|"$', ""), '""', '"')).otherwise(f))


def csv_header(content: Column) -> Column:
    """Fields of the first record."""
    return csv_fields(F.regexp_extract(content.cast("string"), _RECORD, 0))


def _split(documents: DataFrame) -> DataFrame:
    """The documents with their records and the header's fields instead of the content."""
    records = F.regexp_extract_all(c("content").cast("string"), F.lit(_RECORD), F.lit(0))
    return (documents.withColumn("_records", records).drop("content")
            .withColumn("header", csv_fields(F.try_element_at("_records", F.lit(1)))))


def _exploded(split: DataFrame) -> DataFrame:
    rows = split.select("*", F.posexplode("_records").alias("row_no", "_record")).drop("_records")
    return rows.filter(c("row_no") > 0).withColumn("values", csv_fields(c("_record"))).drop("_record")


def csv_rows(documents: DataFrame) -> DataFrame:
    """One row per record: header and values as arrays, row_no from 1. Ragged records are kept."""
    return _exploded(_split(documents))


def _place(name: Column, fold_case: bool = False) -> Column:
    """Number of the last column of that name; one beyond the header if there is none."""
    header = F.transform("header", F.lower) if fold_case else c("header")
    wanted = F.lower(name) if fold_case else name
    return (F.size("header") - F.array_position(F.reverse(header), wanted) + 1).cast("int")


def value_of(name: Column, fold_case: bool = False) -> Column:
    """Value under a header name (the last column of that name), null if absent or the row is short."""
    return F.try_element_at(c("values"), _place(name, fold_case))


_MAPPED = ("amount", "currency", "date", "counterparty", "description", "account_code", "account", "transaction_ref")


def csv_entities(documents: DataFrame) -> DataFrame:
    """CSV documents with their chosen ``column_map`` to entities, before pair folding (S1). The columns' places are
    looked up once a document (N9), the texts that several tests read are columns of their own."""
    places = [_place(F.try_element_at("column_map", F.lit(t))).alias(f"to_{t}") for t in _MAPPED]
    places += [_place(F.lit(n)).alias(f"of_{i}") for i, n in enumerate((*SIDES, "Num", "Ref"))]
    values = _exploded(_split(documents).withColumn("_at", F.struct(*places)))

    def mapped(target: str) -> Column:
        return F.try_element_at("values", c("_at")[f"to_{target}"])

    def own(number: int) -> Column:
        return F.try_element_at("values", c("_at")[f"of_{number}"])

    amount = money.resolve_debit_credit(mapped("amount"), [own(i) for i in range(len(SIDES))])
    rows = values.withColumn("_amount", amount)
    return rows.select(
        "document_id", "client_book_id", "row_no", text.entity_type(c("doc_type")).alias("entity_type"),
        F.coalesce(money.amount_structured(c("_amount")), F.lit(0).cast("long")).alias("amount_cents"),
        F.coalesce(mapped("currency"), F.lit("USD")).alias("currency"),
        dates.date_structured(mapped("date")).alias("transaction_date"),
        mapped("counterparty").alias("counterparty"), mapped("description").alias("description"),
        F.coalesce(mapped("account_code"), mapped("account")).alias("gl_account_code"),
        text.transaction_ref(mapped("transaction_ref"), own(len(SIDES)), own(len(SIDES) + 1)).alias("transaction_ref"),
        F.lit(1).alias("page_number"), F.lit(1.0).alias("extraction_confidence"),
        F.lit("structured").alias("source_format"))


def dedupe_gl_pairs(entities: DataFrame) -> DataFrame:
    """First row per journal entry of a document: by reference, else by date, vendor and absolute
    amount (N16). An aggregate, so both sides of an entry fold before the shuffle."""
    key = F.when(F.length("transaction_ref") > 0, F.concat(F.lit("ref:"), "transaction_ref")).otherwise(
        F.concat_ws("|", F.lit("heur"), F.coalesce(c("transaction_date").cast("string"), F.lit("")),
                    F.coalesce("counterparty", F.lit("")), F.abs("amount_cents").cast("string")))
    kept = [x for x in entities.columns if x != "document_id"]
    return (entities.groupBy("document_id", key.alias("_key"))
            .agg(F.min_by(F.struct(*kept), "row_no").alias("e")).select("document_id", "e.*"))


def scan_csv_entities(documents: DataFrame) -> DataFrame:
    return dedupe_gl_pairs(csv_entities(documents))


def cell_text(kind: Column, value: Column) -> Column:
    """A sheet cell as text: whole floats lose their '.0', serials become dates (null if they are none), empty is ''."""
    serial = F.floor(F.when(kind == "datetime", value).try_cast("double"))
    days = F.when(serial.between(-693_000, 2_958_465), serial).cast("int")  # years 1 to 9999
    return (F.when(kind == "float", F.regexp_replace(F.regexp_replace(value, r"\.0$", ""), ",", ""))
            .when(kind == "datetime", F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), days), "yyyy-MM-dd"))
            .when(kind == "empty", "").otherwise(value))


_TARGETS = ("date", "amount", "counterparty", "description", "account_code", "currency", "transaction_ref")


def excel_cells_to_entities(cells: DataFrame, maps: DataFrame) -> DataFrame:
    """``cells``: (document_id, row_no, col_no, kind, value), row 0 is the header; ``maps``: (document_id,
    doc_type, column_map). Header names compare in lower case; pairs are not folded (S2)."""
    shown = cells.withColumn("value", cell_text(c("kind"), c("value")))
    header = shown.filter("row_no = 0").select("document_id", "col_no", F.lower("value").alias("source"))
    wanted = (maps.select("document_id", F.explode("column_map").alias("target", "source"))
              .withColumn("source", F.lower("source")))
    sides = maps.select("document_id", F.explode(F.array(*(F.struct(F.lit(f"_side{i}").alias("target"), F.lit(s).alias("source"))
                                                            for i, s in enumerate(("debit", "credit", "debit_amount", "credit_amount"))))).alias("s")) \
        .select("document_id", "s.*")
    columns = header.join(wanted.unionByName(sides), ["document_id", "source"]).select("document_id", "col_no", "target")
    values = shown.filter("row_no > 0").join(columns, ["document_id", "col_no"], "left")
    names = (*_TARGETS, *(f"_side{i}" for i in range(4)))
    rows = values.groupBy("document_id", "row_no").agg(
        *(F.max(F.when(c("target") == n, c("value"))).alias(n) for n in names))
    amount = money.resolve_debit_credit(c("amount"), [c(f"_side{i}") for i in range(4)])
    return rows.join(maps.select("document_id", "doc_type"), "document_id").select(
        "document_id", "row_no", text.entity_type(c("doc_type")).alias("entity_type"),
        F.coalesce(money.amount_structured(amount), F.lit(0).cast("long")).alias("amount_cents"),
        F.coalesce("currency", F.lit("USD")).alias("currency"), dates.date_structured(c("date")).alias("transaction_date"),
        "counterparty", "description", c("account_code").alias("gl_account_code"),
        text.transaction_ref(c("transaction_ref")).alias("transaction_ref"))


def scan_ofx_transactions(documents: DataFrame) -> DataFrame:
    """Statement transactions of OFX files (S3). Tags are upper-cased, blank values ignored, the last of
    repeated tags counts."""
    blocks = F.regexp_extract_all(c("content").cast("string"), F.lit(r"(?s)<STMTTRN>(.*?)</STMTTRN>"), F.lit(1))
    found = documents.select("document_id", "client_book_id", F.posexplode(blocks).alias("row_no", "block"))
    tag = r"<(\w+)>([^<]*)"
    names = F.regexp_extract_all("block", F.lit(tag), F.lit(1))
    values = F.regexp_extract_all("block", F.lit(tag), F.lit(2))
    pairs = found.select("document_id", "client_book_id", "row_no", F.filter(
        F.zip_with(names, values, lambda n, v: F.struct(F.upper(n).alias("tag"), strip(v).alias("value"))),
        lambda p: p["value"] != "").alias("tags"))

    def last(name: str) -> Column:
        return F.try_element_at(F.filter("tags", lambda p: p["tag"] == name), F.lit(-1))["value"]

    name, memo, fitid = last("NAME"), last("MEMO"), last("FITID")
    return pairs.select(
        "document_id", "client_book_id", "row_no", F.lit("bank_transaction").alias("entity_type"),
        F.coalesce(money.amount_structured(F.coalesce(last("TRNAMT"), F.lit("0"))), F.lit(0).cast("long")).alias("amount_cents"),
        F.lit("USD").alias("currency"),
        dates.date_structured(F.coalesce(last("DTPOSTED"), last("DTUSER"))).alias("transaction_date"),
        name.alias("counterparty"), text.ofx_description(name, memo, fitid).alias("description"),
        fitid.alias("transaction_ref"), F.lit(1).alias("page_number"), F.lit(1.0).alias("extraction_confidence"),
        F.lit("structured").alias("source_format"))
