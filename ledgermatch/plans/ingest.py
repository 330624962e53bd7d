"""From uploaded files to stored entities, all formats in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.session import materialise
from ledgermatch.sources import documents as D
from ledgermatch.sources import ocr as O
from ledgermatch.sources import structured as S

c = F.col

COLUMNS = ["document_id", "client_book_id", "row_no", "entity_type", "amount_cents", "currency", "transaction_date", "counterparty",
           "description", "gl_account_code", "transaction_ref", "page_number", "extraction_confidence", "source_format"]


def accepted_documents(files: DataFrame, cap: int | None = D.UPLOAD_CAP) -> DataFrame:
    """Registered files, the first of equal ones per book, with their format. Only ids and hashes are shuffled
    to find the copies. The accepted files are written once: two passes read them."""
    accepted = materialise(D.register_documents(files, cap))
    first = D.dedupe_documents_by_hash(accepted).select("client_book_id", "document_id")
    return (accepted.join(first, ["client_book_id", "document_id"], "left_semi")
            .withColumn("format", D.route_format(c("path"), c("content"))))


def ingest_documents(files: DataFrame, maps: DataFrame, cells: DataFrame | None = None, pages: DataFrame | None = None,
                     cap: int | None = D.UPLOAD_CAP) -> DataFrame:
    """Entities of all accepted files, with ids that follow from document and row.

    ``files``: document_id, client_book_id, path, length, content, uploaded_at, deleted; ``maps`` as in
    ``choose_column_map`` (books without maps are read with an empty one); ``cells`` and ``pages``: what sheet
    and OCR readers made of the files routed to them, by document_id.
    """
    docs = materialise(accepted_documents(files, cap))  # read by every format, ledger exports twice

    def routed(name: str) -> DataFrame:
        return docs.filter(c("format") == name)

    def mapped(headers: DataFrame) -> DataFrame:
        return D.choose_column_map(headers, maps).select("document_id", "column_map")

    csv = routed("csv")
    header = csv.select("document_id", "client_book_id", S.csv_header(c("content")).alias("header"))
    parts = [S.scan_csv_entities(csv.join(mapped(header), "document_id")), S.scan_ofx_transactions(routed("ofx"))]
    if cells is not None:
        sheets = routed("xlsx").select("document_id", "client_book_id", "doc_type")
        header = (cells.filter("row_no = 0").groupBy("document_id").agg(F.collect_list("value").alias("header")).join(sheets, "document_id"))
        chosen = sheets.join(mapped(header), "document_id").select("document_id", "doc_type", "column_map")
        parts.append(S.excel_cells_to_entities(cells.join(sheets.select("document_id"), "document_id", "left_semi"), chosen)
                     .join(sheets.select("document_id", "client_book_id"), "document_id")
                     .withColumns({"page_number": F.lit(1), "extraction_confidence": F.lit(1.0), "source_format": F.lit("structured")}))
    if pages is not None:
        books = routed("ocr").select("document_id", "client_book_id")
        parts.append(O.scan_ocr_layout(pages).join(books, "document_id")
                     .withColumn("row_no", c("block_no") * F.lit(1_000_000) + c("line_no")))
    rows = [p.select(*(c(n) if n in p.columns else F.lit(None).cast("string").alias(n) for n in COLUMNS)) for p in parts]
    entities = reduce(DataFrame.unionByName, rows)
    return entities.withColumn("id", F.sha2(F.concat_ws("|", "document_id", "page_number", "row_no"), 256))
