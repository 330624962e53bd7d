"""Source and normalisation queries. Files and layouts are made by Spark from the order and document
tables (bounded chunks per file), parsed back by the library, and compared with the plain rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermatch.functions import dates, geometry, money, text
from ledgermatch.operators.regions import overlapping_regions
from ledgermatch.operators.review import default_reconcilable
from ledgermatch.plans.ingest import ingest_documents
from ledgermatch.plans.registry import SHARED_SQL, query
from ledgermatch.session import scratch_path
from ledgermatch.sources import documents as D
from ledgermatch.sources import ocr as O
from ledgermatch.sources import sinks
from ledgermatch.sources import structured as S

c = F.col
_CHUNK = 400  # order keys per generated file


def _decimal(cents: str):
    n = c(cents)
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def _files(lines, head: str, tail: str = ""):
    """(document_id, client_book_id, content) from (document_id, client_book_id, k, line): at most 400 keys each."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("document_id", "client_book_id").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("content"))


_DOC = "concat(book, '/', CAST(k // {n} AS VARCHAR))".format(n=_CHUNK)


def _doc_id():
    return F.concat("book", F.lit("/"), F.floor(c("k") / _CHUNK).cast("string"))


def _csv_documents(m):
    """Ledger export with a debit and a credit record per journal entry; every third without a number."""
    num = F.when(c("k") % 3 == 0, "").otherwise(F.concat(F.lit("J"), c("k").cast("string")))
    common = [F.date_format("d", "MM/dd/yyyy"), num, F.concat(F.lit('"'), "vendor", F.lit(', ""Main"" Inc"')), F.lit('5" memo'),
              F.when(c("k") % 2 == 0, "4000").otherwise("5000")]
    line = F.concat(F.concat_ws(",", *common, _decimal("cents"), F.lit("")), F.lit("\r\n"),
                    F.concat_ws(",", *common, F.lit(""), _decimal("cents")))
    rows = m.sales.select(_doc_id().alias("document_id"), c("book").alias("client_book_id"), "k", line.alias("line"))
    return (_files(rows, "Transaction Date,Num,Name,Memo,Account,Debit,Credit\n").withColumn("doc_type", F.lit("gl_export"))
            .withColumn("column_map", F.create_map(*(F.lit(x) for x in (
                "date", "Transaction Date", "amount", "Debit", "counterparty", "Name", "description", "Memo",
                "account_code", "Account")))))


def _csv_sql(folded: bool) -> str:
    once = f"""QUALIFY row_number() OVER (PARTITION BY {_DOC}, CASE WHEN k % 3 = 0
        THEN concat_ws('|', CAST(d AS VARCHAR), vendor, CAST(cents AS VARCHAR)) ELSE CAST(k AS VARCHAR) END ORDER BY k) = 1"""
    twice = "CROSS JOIN (SELECT unnest([0, 1]) AS side)"
    return f"""SELECT {_DOC} AS document_id, 'gl_entry' AS entity_type, cents AS amount_cents, d AS transaction_date,
        vendor || ', "Main" Inc' AS counterparty, '5" memo' AS description, CASE WHEN k % 2 = 0 THEN '4000' ELSE '5000' END AS gl_account_code,
        CASE WHEN k % 3 <> 0 THEN 'J' || k END AS transaction_ref FROM {{sales}} {once if folded else twice}"""


_ENTITY = ["document_id", "entity_type", "amount_cents", "transaction_date", "counterparty", "description",
           "gl_account_code", "transaction_ref"]


@query("scan_csv_entities", _csv_sql(True))
def _(m):
    return S.scan_csv_entities(_csv_documents(m)).select(_ENTITY)


@query("apply_column_map", _csv_sql(False))
def _(m):
    return S.csv_entities(_csv_documents(m)).select(_ENTITY)


@query("dedupe_gl_pairs", f"SELECT document_id, count(*) AS n FROM ({_csv_sql(True)}) t GROUP BY document_id")
def _(m):
    return S.dedupe_gl_pairs(S.csv_entities(_csv_documents(m))).groupBy("document_id").agg(F.count("*").alias("n"))


@query("excel_cells_to_entities", f"""SELECT {_DOC} AS document_id, 'bank_transaction' AS entity_type, cents AS amount_cents,
    d AS transaction_date, vendor AS counterparty FROM {{sales}}""")
def _(m):
    """Cells with a serial date and a float amount in the debit or the credit column."""
    def cell(col, kind, value):
        return F.struct(F.lit(col).alias("col_no"), F.lit(kind).alias("kind"), value.alias("value"))

    serial = F.datediff("d", F.lit("1899-12-30").cast("date")).cast("string")
    debit = F.when(c("k") % 2 == 0, _decimal("cents")).otherwise("")
    credit = F.when(c("k") % 2 == 1, _decimal("cents")).otherwise("")
    body = m.sales.select(_doc_id().alias("document_id"), c("k").alias("key"), F.explode(F.array(
        cell(0, "datetime", serial), cell(1, "string", c("vendor")), cell(2, "string", debit), cell(3, "string", credit))).alias("x"))
    head = m.sales.select(_doc_id().alias("document_id")).distinct()
    header = head.select("document_id", F.lit(0).cast("long").alias("row_no"), F.explode(F.array(
        *(cell(i, "string", F.lit(n)) for i, n in enumerate(("Posted", "Payee", "Debit", "Credit"))))).alias("x"))
    cells = body.select("document_id", (c("key") + 1).alias("row_no"), "x.*").unionByName(header.select("document_id", "row_no", "x.*"))
    maps = head.withColumn("doc_type", F.lit("bank_statement")).withColumn("column_map", F.create_map(
        *(F.lit(x) for x in ("date", "posted", "counterparty", "Payee", "amount", "Debit"))))
    return S.excel_cells_to_entities(cells, maps).select(
        "document_id", "entity_type", "amount_cents", "transaction_date", "counterparty")


@query("scan_ofx_transactions", f"""SELECT {_DOC} AS document_id, -cents AS amount_cents, d AS transaction_date,
    CASE WHEN k % 5 <> 0 THEN upper(vendor) END AS counterparty,
    CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN upper(vendor) || ' — order ' || k WHEN k % 5 <> 0 THEN upper(vendor)
         WHEN k % 2 = 0 THEN 'order ' || k ELSE 'T' || k END AS description, 'T' || k AS transaction_ref FROM {{sales}}""")
def _(m):
    return S.scan_ofx_transactions(_ofx_documents(m)).select(
        "document_id", "amount_cents", "transaction_date", "counterparty", "description", "transaction_ref")


def _ofx_documents(m):
    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit("\n"))

    stamp = F.concat(F.date_format("d", "yyyyMMdd"), F.lit("120000"))
    day = F.when(c("k") % 7 == 0, tag("DTUSER", stamp)).otherwise(tag("DTPOSTED", stamp))
    name = F.when(c("k") % 5 == 0, tag("NAME", F.lit(" "))).otherwise(tag("name", F.upper("vendor")))
    memo = F.when(c("k") % 2 == 0, tag("MEMO", F.concat(F.lit("order "), c("k").cast("string")))).otherwise("")
    amount = F.concat(tag("TRNAMT", F.lit("1.00")), tag("TRNAMT", F.concat(F.lit("-"), _decimal("cents"))))
    line = F.concat(F.lit("<STMTTRN>\n"), tag("TRNTYPE", F.lit("DEBIT")), day, amount,
                    tag("FITID", F.concat(F.lit("T"), c("k").cast("string"))), name, memo, F.lit("</STMTTRN>"))
    rows = m.sales.select(_doc_id().alias("document_id"), c("book").alias("client_book_id"), "k", line.alias("line"))
    return _files(rows, "OFXHEADER:100\n<OFX><BANKTRANLIST>\n", "\n</BANKTRANLIST></OFX>")


# Ledger exports and statements uploaded together, every ledger export twice; two maps a book, the newer one fits worse.
@query("ingest_documents", f"""SELECT 'csv/' || document_id AS document_id, entity_type, amount_cents, transaction_date, counterparty, transaction_ref
    FROM ({_csv_sql(True)}) t
    UNION ALL SELECT 'ofx/' || {_DOC}, 'bank_transaction', -cents, d, CASE WHEN k % 5 <> 0 THEN upper(vendor) END, 'T' || k FROM {{sales}}""")
def _(m):
    def upload(files, kind, at, prefix):
        return files.select(F.concat(F.lit(prefix), "document_id").alias("document_id"), "client_book_id",
                            F.concat("document_id", F.lit(f".{kind}")).alias("path"), F.length("content").alias("length"), "content",
                            F.lit(at).alias("uploaded_at"), F.lit(False).alias("deleted"))

    ledger = _csv_documents(m)
    files = upload(ledger, "csv", 1, "csv/").unionByName(upload(ledger, "csv", 2, "again/")).unionByName(upload(_ofx_documents(m), "ofx", 1, "ofx/"))
    books = m.books.select(c("id").alias("client_book_id"))
    good = books.select("client_book_id", F.lit(1).alias("map_id"), F.lit(1).alias("created_at"), F.create_map(*(F.lit(x) for x in (
        "date", "Transaction Date", "amount", "Debit", "counterparty", "Name", "description", "Memo", "account_code", "Account"))).alias("column_map"))
    poor = books.select("client_book_id", F.lit(2).alias("map_id"), F.lit(2).alias("created_at"),
                        F.create_map(F.lit("amount"), F.lit("Credit")).alias("column_map"))
    return ingest_documents(files, good.unionByName(poor)).select(
        "document_id", "entity_type", "amount_cents", "transaction_date", "counterparty", "transaction_ref")


# ---- lines of text ------------------------------------------------------------------------------
# A statement page made of a document: vendor, number, dates, an amount, then the document's own text.
SHARED_SQL.update({
    "page_lines": r"""SELECT doc_id, i AS line_no, CASE i
          WHEN 0 THEN 'Vendor ' || source || ' Services'
          WHEN 1 THEN 'Invoice #: ' || doc_id || CASE WHEN doc_id % 5 = 0 THEN ' ref 1234567890123456789012345.00' ELSE '' END
          WHEN 2 THEN 'Net ' || strftime(DATE '2023-01-01' + CAST(doc_id % 700 AS INT), '%Y-%m-%d')
          WHEN 3 THEN 'Date: ' || strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INT), '%m/%d/%Y')
          WHEN 4 THEN 'Amount due $' || (n_chars // 100) || '.' || lpad(CAST(n_chars % 100 AS VARCHAR), 2, '0') || ' of -5.00'
          ELSE parts[i - 4] END AS text
        FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents) d, range(0, 5 + len(parts)) r(i)""",
    "line_values": r"""SELECT doc_id, line_no, text,
        list_filter(list_transform(regexp_extract_all(text, '[0-9.,$\-]+'),
            lambda r: CASE WHEN regexp_matches(regexp_replace(regexp_replace(r, '^[$\-]+', ''), '[,$]', '', 'g'), '^[0-9]+\.[0-9]{2}$')
              THEN TRY_CAST(replace(regexp_replace(regexp_replace(r, '^[$\-]+', ''), '[,$]', '', 'g'), '.', '') AS BIGINT)
                   * CASE WHEN starts_with(r, '-') THEN -1 ELSE 1 END END), lambda v: v IS NOT NULL) AS amounts,
        coalesce(
          TRY_CAST(nullif(regexp_extract(text, '(?:^|[^0-9/.\-])(\d{4}-\d{2}-\d{2})(?:$|[^0-9/.\-])', 1), '') AS DATE),
          CAST(try_strptime(nullif(regexp_extract(text, '(?:^|[^0-9/.\-])(\d{2}/\d{2}/\d{4})(?:$|[^0-9/.\-])', 1), ''), '%m/%d/%Y') AS DATE),
          CAST(try_strptime(nullif(regexp_extract(text, '(?:^|[^0-9/.\-])(\d{2}/\d{2}/\d{4})(?:$|[^0-9/.\-])', 1), ''), '%d/%m/%Y') AS DATE),
          CAST(try_strptime(nullif(regexp_extract(text, '(?:^|[^0-9/.\-])(\d{8})(?:$|[^0-9/.\-])', 1), ''), '%Y%m%d') AS DATE)) AS found
        FROM {page_lines}""",
    "line_facts": """SELECT doc_id, line_no, text, found, CASE WHEN len(amounts) > 0 THEN
            list_last(list_filter(amounts, lambda v: abs(v) = list_max(list_transform(amounts, lambda w: abs(w))))) END AS amount
        FROM {line_values}""",
})
SHARED_SQL["line_facts"] = """SELECT doc_id, line_no, text, found, CASE WHEN len(amounts) > 0 THEN
            list_filter(amounts, lambda v: abs(v) = list_max(list_transform(amounts, lambda w: abs(w))))[-1] END AS amount
        FROM {line_values}"""


def _texts(m):
    """doc_id and the array of its lines."""
    d = m.documents
    amount = F.concat(F.floor(c("n_chars") / 100).cast("string"), F.lit("."), F.lpad((c("n_chars") % 100).cast("string"), 2, "0"))

    def day(start, n, pattern):
        return F.date_format(F.date_add(F.lit(start).cast("date"), (c("doc_id") % n).cast("int")), pattern)

    head = F.array(F.concat(F.lit("Vendor "), "source", F.lit(" Services")),
                   F.concat(F.lit("Invoice #: "), c("doc_id").cast("string"),
                            F.when(c("doc_id") % 5 == 0, " ref 1234567890123456789012345.00").otherwise("")),
                   F.concat(F.lit("Net "), day("2023-01-01", 700, "yyyy-MM-dd")),
                   F.concat(F.lit("Date: "), day("2024-01-01", 300, "MM/dd/yyyy")),
                   F.concat(F.lit("Amount due $"), amount, F.lit(" of -5.00")))
    return d.select("doc_id", F.concat(head, F.split("text", "\n")).alias("lines"))


def _line_rows(m):
    return _texts(m).select("doc_id", F.posexplode("lines").alias("line_no", "text"))


def _pages(m):
    """The same lines as nested OCR pages: one block, a line every hundredth of the page."""
    def corner(x, y):
        return F.array(x, y)

    def line(t, i):
        y = i.cast("double") * 10
        square = F.array(corner(F.lit(20.0), y), corner(F.lit(500.0), y), corner(F.lit(500.0), y + 8), corner(F.lit(20.0), y + 8))
        words = F.transform(F.split(t, " "), lambda w: F.struct(w.alias("value"), F.lit(0.9).alias("confidence"), square.alias("geometry")))
        return F.struct(square.alias("geometry"), F.lit(0.9).alias("confidence"), words.alias("words"))

    block = F.struct(F.array().cast("array<array<double>>").alias("geometry"), F.lit(0.9).alias("confidence"),
                     F.transform("lines", line).alias("lines"))
    return _texts(m).select(c("doc_id").cast("string").alias("document_id"), F.lit("invoice").alias("doc_type"),
                            F.lit(1).alias("page_number"), F.lit(1000.0).alias("width"), F.lit(2000.0).alias("height"),
                            F.array(block).alias("blocks"))


@query("extract_line_amount", "SELECT doc_id, CAST(line_no AS INT) AS line_no, amount FROM {line_facts} WHERE amount IS NOT NULL")
def _(m):
    return _line_rows(m).select("doc_id", "line_no", money.line_amount(c("text")).alias("amount")).filter("amount is not null")


@query("extract_line_date", "SELECT doc_id, CAST(line_no AS INT) AS line_no, found FROM {line_facts} WHERE found IS NOT NULL")
def _(m):
    return _line_rows(m).select("doc_id", "line_no", dates.line_date(c("text")).alias("found")).filter("found is not null")


_SKIP = "^(" + "|".join(O.BOILERPLATE) + ")"
SHARED_SQL["ocr_rows"] = f"""SELECT a.doc_id, a.line_no, a.amount, a.text,
        coalesce(a.found, (SELECT arg_min(o.found, (CASE WHEN contains(o.text, 'Date:') THEN 0 ELSE 1000000 END) + abs(o.line_no - a.line_no) + o.line_no / 1e7)
                           FROM {{line_facts}} o WHERE o.doc_id = a.doc_id AND o.text <> a.text AND o.found IS NOT NULL)) AS found,
        (SELECT arg_min(trim(o.text, chr(10) || chr(13) || chr(9) || ' '), o.line_no) FROM {{line_facts}} o
          WHERE o.doc_id = a.doc_id AND trim(o.text) <> '' AND trim(o.text) <> trim(a.text)
            AND NOT regexp_matches(lower(trim(o.text)), '{_SKIP}') AND o.amount IS NULL AND o.found IS NULL
            AND regexp_matches(o.text, '\\p{{L}}')) AS vendor
        FROM {{line_facts}} a WHERE a.amount IS NOT NULL"""
SHARED_SQL["ocr_rows"] = SHARED_SQL["ocr_rows"].replace("\\p{L}", "[[:alpha:]]")


@query("scan_ocr_layout", """SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(line_no AS INT) AS line_no, amount AS amount_cents,
    found AS transaction_date, vendor AS counterparty, text AS description, 0.02e0 AS x, line_no * 10.0e0 / 2000.0e0 AS y,
    0.48e0 AS width, (line_no * 10.0e0 + 8 - line_no * 10.0e0) / 2000.0e0 AS height FROM {ocr_rows}""")
def _(m):
    return O.scan_ocr_layout(_pages(m)).select("document_id", "line_no", "amount_cents", "transaction_date", "counterparty",
                                               "description", "bbox.*")


@query("attach_date_to_amount_line", "SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(line_no AS INT) AS line_no, found AS transaction_date FROM {ocr_rows}")
def _(m):
    return O.scan_ocr_layout(_pages(m)).select("document_id", "line_no", "transaction_date")


@query("attach_counterparty_to_amount_line", "SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(line_no AS INT) AS line_no, vendor AS counterparty FROM {ocr_rows}")
def _(m):
    return O.scan_ocr_layout(_pages(m)).select("document_id", "line_no", "counterparty")


@query("document_context_text", """SELECT CAST(doc_id AS VARCHAR) AS document_id,
    string_agg('[' || (line_no + 1) || '] ' || text, chr(10) ORDER BY line_no) AS context FROM {page_lines} GROUP BY doc_id""")
def _(m):
    return O.document_context_text(_line_rows(m).withColumnRenamed("doc_id", "document_id").withColumn(
        "document_id", c("document_id").cast("string")))


# ---- amounts, dates, texts ----------------------------------------------------------------------
# One amount text and one date text per order, in rotating styles.
SHARED_SQL["styled"] = """SELECT k, cents, d, CASE WHEN k % 16 = 1 THEN chr(9) || '-' || whole || '.' || frac WHEN k % 16 = 2 THEN whole || '0000000000000000000000000'
        WHEN k % 8 = 0 THEN '$' || whole || '.' || frac WHEN k % 8 = 1 THEN '-' || whole || '.' || frac WHEN k % 8 = 2 THEN whole
        WHEN k % 8 = 3 THEN '(' || whole || '.' || frac || ')' WHEN k % 8 = 4 THEN 'N/A' WHEN k % 8 = 5 THEN '€' || whole || ',' || frac
        WHEN k % 8 = 6 THEN whole || '-' || frac ELSE '  +' || whole || '.' || frac || ' ' END AS amount_text,
        CASE k % 9 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%m/%d/%Y') WHEN 2 THEN strftime(d, '%d/%m/%Y')
        WHEN 3 THEN strftime(d, '%m/%d/%y') WHEN 4 THEN strftime(d, '%d-%m-%Y') WHEN 5 THEN strftime(d, '%Y%m%d')
        WHEN 6 THEN strftime(d, '%Y%m%d') || '093000' WHEN 7 THEN '"' || strftime(d, '%Y-%m-%d') || '"' ELSE 'soon' END AS date_text
        FROM (SELECT k, cents, d, CAST(cents // 100 AS VARCHAR) AS whole, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS frac FROM {sales}) s"""


def _styled(m):
    whole, frac = F.floor(c("cents") / 100).cast("string"), F.lpad((c("cents") % 100).cast("string"), 2, "0")
    dotted = F.concat(whole, F.lit("."), frac)
    styles = [F.concat(F.lit("$"), dotted), F.concat(F.lit("-"), dotted), whole, F.concat(F.lit("("), dotted, F.lit(")")), F.lit("N/A"),
              F.concat(F.lit("€"), whole, F.lit(","), frac), F.concat(whole, F.lit("-"), frac), F.concat(F.lit("  +"), dotted, F.lit(" "))]
    layouts = [F.date_format("d", p) for p in ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "MM/dd/yy", "dd-MM-yyyy", "yyyyMMdd")]
    layouts += [F.concat(F.date_format("d", "yyyyMMdd"), F.lit("093000")), F.concat(F.lit('"'), F.date_format("d", "yyyy-MM-dd"), F.lit('"')), F.lit("soon")]
    return m.sales.select("k", "cents", "d",
                          F.when(c("k") % 16 == 1, F.concat(F.lit("\t-"), dotted)).when(c("k") % 16 == 2, F.concat(whole, F.lit("0" * 25)))
                          .otherwise(F.element_at(F.array(*styles), (c("k") % 8 + 1).cast("int"))).alias("amount_text"),
                          F.element_at(F.array(*layouts), (c("k") % 9 + 1).cast("int")).alias("date_text"))


@query("normalise_amount_structured", """SELECT k, CASE WHEN regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$')
    THEN TRY_CAST(round(CAST(t AS DOUBLE) * 100) AS BIGINT) END AS cents
    FROM (SELECT k, regexp_replace(amount_text, '[^0-9.+\\-]', '', 'g') AS t FROM {styled}) s""")
def _(m):
    return _styled(m).select("k", money.amount_structured(c("amount_text")).alias("cents"))


SHARED_SQL["verbatim"] = """SELECT k, starts_with(t, '-') OR (starts_with(t, '(') AND ends_with(t, ')')) AS negative,
        coalesce(CASE WHEN contains(n, '.') THEN TRY_CAST(round_even(CAST(n AS DOUBLE) * 100, 0) AS BIGINT) ELSE TRY_CAST(n AS BIGINT) END, 0) AS size
        FROM (SELECT k, trim(amount_text, chr(9) || ' ') AS t, regexp_replace(amount_text, '[^0-9.]', '', 'g') AS n FROM {styled}) s"""


@query("normalise_amount_verbatim", "SELECT k, CASE WHEN negative THEN -size ELSE size END AS cents FROM {verbatim}")
def _(m):
    return _styled(m).select("k", money.amount_verbatim(c("amount_text")).alias("cents"))


@query("normalise_amount_citation", "SELECT k, size AS cents FROM {verbatim}")
def _(m):
    return _styled(m).select("k", money.amount_citation(c("amount_text")).alias("cents"))


def _date_sql(kinds: str) -> str:
    return f"""SELECT k, CASE WHEN k % 9 IN ({kinds}) THEN CASE
        WHEN k % 9 = 2 AND day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END END AS found FROM {{sales}}"""


@query("normalise_date_structured", _date_sql("0, 1, 2, 3, 4, 5, 6, 7"))
def _(m):
    return _styled(m).select("k", dates.date_structured(c("date_text")).alias("found"))


@query("normalise_date_verbatim", _date_sql("0, 1, 2"))
def _(m):
    return _styled(m).select("k", dates.date_verbatim(c("date_text")).alias("found"))


@query("resolve_debit_credit", """SELECT k, CASE k % 4 WHEN 0 THEN 'a' || k WHEN 1 THEN 'd' || k WHEN 2 THEN 'c' || k ELSE '' END AS amount_text FROM {sales}""")
def _(m):
    def only(n, letter):
        return F.when(c("k") % 4 == n, F.concat(F.lit(letter), c("k").cast("string"))).otherwise(" ")
    return m.sales.select("k", money.resolve_debit_credit(only(0, "a"), [only(1, "d"), only(2, "c")]).alias("amount_text"))


@query("format_cents", """SELECT id, CASE WHEN amount_cents < 0 THEN '-' ELSE '' END || '$' || format('{:,}', abs(amount_cents) // 100)
    || '.' || lpad(CAST(abs(amount_cents) % 100 AS VARCHAR), 2, '0') AS shown FROM {entities}""".replace("{:,}", "@@"))
def _(m):
    return m.entities.select("id", money.format_cents(c("amount_cents")).alias("shown"))


@query("entity_type_from_doc_type", """SELECT id, CASE requested_doc_type WHEN 'bank_statement' THEN 'bank_transaction'
    WHEN 'gl_export' THEN 'gl_entry' ELSE 'invoice_line_item' END AS entity_type FROM {requests}""")
def _(m):
    return m.requests.select("id", text.entity_type(c("requested_doc_type")).alias("entity_type"))


@query("classify_subtype", """SELECT id, CASE WHEN entity_subtype <> 'standard' THEN entity_subtype
    WHEN regexp_matches(upper(description), 'CREDIT MEMO|CREDIT NOTE|CREDITS') THEN 'credit_note'
    WHEN regexp_matches(upper(description), 'REFUND|REIMBURSEMENT') THEN 'refund'
    WHEN regexp_matches(upper(description), 'VOID|REVERSAL|REVERSED') THEN 'void' ELSE entity_subtype END AS entity_subtype FROM {entities}""")
def _(m):
    return m.entities.select("id", text.subtype(c("entity_subtype"), c("description")).alias("entity_subtype"))


@query("ofx_description", """SELECT id, coalesce(counterparty || ' — ' || gl_account_code, counterparty, gl_account_code, transaction_ref) AS shown FROM {entities}""")
def _(m):
    return m.entities.select("id", text.ofx_description(c("counterparty"), c("gl_account_code"), c("transaction_ref")).alias("shown"))


@query("transaction_ref", "SELECT id, nullif(trim(coalesce(gl_account_code, CASE WHEN seq % 5 = 0 THEN ' ' ELSE transaction_ref END)), '') AS ref FROM {entities}")
def _(m):
    other = F.when(c("seq") % 5 == 0, " ").otherwise(c("transaction_ref"))
    return m.entities.select("id", text.transaction_ref(c("gl_account_code"), other).alias("ref"))


@query("default_reconcilable", "SELECT client_book_id, account_code, CASE WHEN account_code = '1100' THEN false ELSE account_type <> 'equity' END AS reconcilable FROM {accounts}")
def _(m):
    given = F.when(c("account_code") == "1100", F.lit(False))
    return m.accounts.select("client_book_id", "account_code", default_reconcilable(given, c("account_type")).alias("reconcilable"))


@query("config_value_text", "SELECT id, CAST(tolerance_cents AS VARCHAR) AS a, CAST(seq_flag AS VARCHAR) AS b FROM (SELECT id, tolerance_cents, tolerance_mode = 'fixed' AS seq_flag FROM {books}) t")
def _(m):
    return m.books.select("id", text.value_text(c("tolerance_cents")).alias("a"), text.value_text(c("tolerance_mode") == "fixed").alias("b"))


# ---- stored model answers -----------------------------------------------------------------------
def _answers(m):
    item = F.concat(F.lit('{"amount_raw": "$'), _decimal("cents"), F.lit('", "transaction_date": "'), F.date_format("d", "MM/dd/yyyy"),
                    F.lit('", "counterparty": "'), "vendor", F.lit('", "entity_subtype": null}'))
    array = F.concat(F.lit("[5, "), item, F.lit(', "x", null]'))
    return m.sales.select(c("k").cast("string").alias("document_id"), F.when(c("k") % 4 == 0, F.concat(F.lit("```json\n"), array, F.lit("\n```")))
                          .when(c("k") % 4 == 1, array).when(c("k") % 4 == 2, F.concat(F.lit("Here it is: "), array, F.lit(" done")))
                          .otherwise("no rows found").alias("answer"))


@query("salvage_json_arrays", "SELECT CAST(k AS VARCHAR) AS document_id, CASE WHEN k % 4 < 3 THEN 4 ELSE 0 END AS items FROM {sales}")
def _(m):
    return _answers(m).select("document_id", F.json_array_length(text.salvage_json_array(c("answer"))).alias("items"))


@query("model_rows_to_entities", """SELECT CAST(k AS VARCHAR) AS document_id, 'invoice_line_item' AS entity_type, 'standard' AS entity_subtype,
    cents AS amount_cents, 'USD' AS currency, d AS transaction_date, vendor AS counterparty FROM {sales} WHERE k % 4 < 3""")
def _(m):
    return O.model_rows_to_entities(_answers(m)).select(
        "document_id", "entity_type", "entity_subtype", "amount_cents", "currency", "transaction_date", "counterparty")


SHARED_SQL["carrying"] = """SELECT doc_id, line_no FROM (
        SELECT doc_id, line_no, regexp_replace(text, '[^0-9.]', '', 'g') AS n, n_chars FROM {page_lines} JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)) t
        WHERE coalesce(CASE WHEN regexp_matches(n, '^([0-9]+\\.[0-9]*|\\.[0-9]+)$') THEN TRY_CAST(round_even(CAST(n AS DOUBLE) * 100, 0) AS BIGINT)
                   WHEN regexp_matches(n, '^[0-9]+$') THEN TRY_CAST(n AS BIGINT) END, 0) = doc_id"""


@query("ground_citations", """SELECT CAST(d.doc_id AS VARCHAR) AS document_id, coalesce(
        (SELECT string_agg(line_no, ',' ORDER BY line_no) FROM {carrying} t WHERE t.doc_id = d.doc_id AND line_no IN (0, 3)),
        (SELECT string_agg(line_no, ',' ORDER BY line_no) FROM (SELECT line_no FROM {carrying} t WHERE t.doc_id = d.doc_id ORDER BY line_no LIMIT 3)),
        '0,3') AS indices FROM documents d""")
def _(m):
    lines = _line_rows(m).select(c("doc_id").cast("string").alias("document_id"), "line_no", "text")
    cited = m.documents.select(c("doc_id").cast("string").alias("document_id"), c("doc_id").alias("total_cents"),
                               F.array(F.lit(0), F.lit(3)).alias("indices"))
    return O.ground_citations(cited, lines).select("document_id", F.concat_ws(",", c("indices").cast("array<string>")).alias("indices"))


# ---- geometry -----------------------------------------------------------------------------------
@query("normalise_bbox", """SELECT id, box_x / 2 AS x, box_y / 4 AS y, box_w / 2 AS width, box_h / 4 AS height FROM {entities}""")
def _(m):
    x, y, w, h = (c(n) for n in ("box_x", "box_y", "box_w", "box_h"))
    corners = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
    b = geometry.normalise_polygon(corners, F.lit(2.0), F.lit(4.0))
    return m.entities.select("id", b.alias("b")).select("id", *(F.round(f"b.{n}", 6).alias(n) for n in ("x", "y", "width", "height")))


SHARED_SQL["boxes"] = "SELECT id, source_document_id, page_number, box_x, box_y, box_w, box_h FROM {entities}"


# The equality first, in a table of its own, so that the boxes are compared within a page only.
SHARED_SQL["same_page"] = """SELECT a.id AS id_a, b.id AS id_b, a.box_x AS ax, a.box_y AS ay, a.box_w AS aw, a.box_h AS ah,
        b.box_x AS bx, b.box_y AS by_, b.box_w AS bw, b.box_h AS bh
    FROM {boxes} a JOIN {boxes} b ON a.source_document_id = b.source_document_id AND a.page_number = b.page_number WHERE a.id < b.id"""
SHARED_SQL["shared_area"] = """SELECT *, (least(ax + aw, bx + bw) - greatest(ax, bx)) * (least(ay + ah, by_ + bh) - greatest(ay, by_)) AS o FROM {same_page}
    WHERE ax < bx + bw AND ax + aw > bx AND ay < by_ + bh AND ay + ah > by_"""


@query("overlapping_regions", "SELECT id_a, id_b, round(o / (aw * ah + bw * bh - o), 4) AS iou FROM {shared_area}")
def _(m):
    regions = m.entities.select("id", "source_document_id", "page_number", geometry.box(
        c("box_x"), c("box_y"), c("box_w"), c("box_h")).alias("bbox"))
    return overlapping_regions(regions).select("id_a", "id_b", F.round("iou", 4).alias("iou"))


@query("overlapping_region_measures", """SELECT id_a, id_b, bx >= ax AND by_ >= ay AND bx + bw <= ax + aw AND by_ + bh <= ay + ah AS a_contains_b,
    ax >= bx AND ay >= by_ AND ax + aw <= bx + bw AND ay + ah <= by_ + bh AS b_contains_a, round(o, 6) AS area,
    round(ax + aw / 2, 6) AS center_x, round(ay + ah / 2, 6) AS center_y FROM {shared_area}""")
def _(m):
    regions = m.entities.select("id", "source_document_id", "page_number", geometry.box(
        c("box_x"), c("box_y"), c("box_w"), c("box_h")).alias("bbox"))
    return overlapping_regions(regions).select("id_a", "id_b", "a_contains_b", "b_contains_a", F.round("area", 6).alias("area"),
                                               F.round("center_a.x", 6).alias("center_x"), F.round("center_a.y", 6).alias("center_y"))


# ---- documents ----------------------------------------------------------------------------------
def _uploads(m):
    names = F.element_at(F.array(*(F.lit(x) for x in (".CSV", ".xlsx", ".ofx", ".pdf", ".txt", ".xls", ".dat"))), (c("doc_id") % 7 + 1).cast("int"))
    return m.documents.select(
        c("doc_id").cast("string").alias("document_id"), c("source").alias("client_book_id"),
        F.concat(F.lit("in/"), c("doc_id").cast("string"), names).alias("path"), (c("n_chars") * 2000).alias("length"),
        c("text").alias("content"), c("doc_id").alias("uploaded_at"), (c("doc_id") % 10 == 0).alias("deleted"))


SHARED_SQL["uploads"] = """SELECT CAST(doc_id AS VARCHAR) AS document_id, source AS client_book_id, doc_id % 7 AS kind, n_chars * 2000 AS length,
    text AS content, doc_id AS uploaded_at, doc_id % 10 = 0 AS deleted FROM documents"""


@query("route_documents_by_format", """SELECT document_id, CASE kind WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' WHEN 5 THEN 'xlsx' WHEN 2 THEN 'ofx' WHEN 3 THEN 'ocr'
    ELSE CASE WHEN starts_with(content, 'OFXHEADER') OR starts_with(content, '<?xml') THEN 'ofx'
              WHEN contains(content, ',') AND octet_length(encode(substr(content, 1, position(',' IN content)))) <= 2048 THEN 'csv' ELSE 'ocr' END END AS format FROM {uploads}""")
def _(m):
    return _uploads(m).select("document_id", D.route_format(c("path"), c("content")).alias("format"))


@query("register_documents", """SELECT document_id, CASE WHEN kind IN (0, 1) THEN 'gl_export' WHEN kind = 2 THEN 'bank_statement' ELSE 'invoice' END AS doc_type
    FROM {uploads} WHERE kind IN (0, 1, 2, 3) AND length <= 26214400""")
def _(m):
    return D.register_documents(_uploads(m)).select("document_id", "doc_type")


@query("refused_documents", """SELECT document_id, CASE WHEN kind IN (4, 5, 6) THEN 'unsupported type' ELSE 'too large' END AS refused
    FROM {uploads} WHERE kind IN (4, 5, 6) OR length > 26214400""")
def _(m):
    return D.refused_documents(_uploads(m)).select("document_id", "refused")


@query("dedupe_documents_by_hash", """SELECT client_book_id, sha256(content) AS content_hash, document_id FROM {uploads} WHERE NOT deleted
    QUALIFY row_number() OVER (PARTITION BY client_book_id, sha256(content) ORDER BY uploaded_at) = 1""")
def _(m):
    return D.dedupe_documents_by_hash(_uploads(m)).select("client_book_id", "content_hash", "document_id")


@query("list_documents", """SELECT document_id, client_book_id FROM {uploads} WHERE NOT deleted
    QUALIFY row_number() OVER (PARTITION BY client_book_id ORDER BY uploaded_at DESC, document_id) <= 100""")
def _(m):
    return D.list_documents(_uploads(m).drop("content")).select("document_id", "client_book_id")


@query("persist_entities", """SELECT id, client_book_id, nullif(counterparty, '') AS counterparty,
    CASE WHEN seq % 6 <> 0 THEN transaction_date END AS transaction_date FROM {entities}""")
def _(m):
    path = scratch_path(m.spark)
    raw = m.entities.select("id", "client_book_id", F.coalesce("counterparty", F.lit("")).alias("counterparty"), F.when(c("seq") % 6 == 0, "n/a").otherwise(
        c("transaction_date").cast("string")).alias("transaction_date"))
    sinks.persist_entities(raw.filter("substring(id, 1, 1) = 'i'"), path)
    sinks.persist_entities(raw, path)  # adds the rest
    sinks.persist_entities(raw, path)  # a replay adds nothing
    return m.spark.read.schema("id string, counterparty string, transaction_date date, client_book_id string").parquet(path)


# ---- column maps --------------------------------------------------------------------------------
_HEADERS = ("Transaction Date,Num,Name,Memo,Account,Debit,Credit", "date,amount,description,counterparty", "Posted,Ref 1,Payee,Value,GL Code")


def _headers(m):
    return m.users.select(c("id").alias("document_id"), c("home_book").alias("client_book_id"), "seq", F.split(
        F.element_at(F.array(*(F.lit(h) for h in _HEADERS)), (c("seq") % 3 + 1).cast("int")), ",").alias("header"))


@query("choose_column_map", """SELECT u.id AS document_id, arg_max(mp, score * 10 + mp) AS map_no FROM (
    SELECT u.id, mp, CASE WHEN mp = 1 THEN CASE u.seq % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END
                          ELSE CASE u.seq % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 0 END END AS score
    FROM {users} u JOIN {books} b ON b.id = u.home_book, (SELECT unnest([1, 2]) AS mp) x) u GROUP BY u.id""")
def _(m):
    def fields(*pairs):
        return F.create_map(*(F.lit(x) for x in pairs))

    one = m.books.select(c("id").alias("client_book_id"), F.lit(1).alias("map_id"), F.lit(1).alias("created_at"),
                         fields("amount", "debit", "counterparty", "Name", "date", "transaction date", "description", "Description").alias("column_map"))
    two = m.books.select(c("id").alias("client_book_id"), F.lit(2).alias("map_id"), F.lit(2).alias("created_at"),
                         fields("amount", "AMOUNT", "date", "Date").alias("column_map"))
    return D.choose_column_map(_headers(m), one.unionByName(two)).select("document_id", c("map_id").alias("map_no"))


@query("suggest_column_map", """SELECT id AS document_id, t.target, CASE seq % 3 WHEN 0 THEN t.a WHEN 1 THEN t.b ELSE t.c END AS source
    FROM {users}, (VALUES ('date', 'Transaction Date', 'date', NULL), ('amount', NULL, 'amount', 'Value'),
      ('debit', 'Debit', NULL, NULL), ('credit', 'Credit', 'description', NULL), ('counterparty', 'Name', 'description', 'Payee'),
      ('account', 'Account', NULL, 'GL Code'), ('transaction_ref', 'Transaction Date', NULL, 'Ref 1')) t(target, a, b, c)
    WHERE CASE seq % 3 WHEN 0 THEN t.a WHEN 1 THEN t.b ELSE t.c END IS NOT NULL""")
def _(m):
    return D.suggest_column_map(_headers(m).select("document_id", F.posexplode("header").alias("position", "name")))
