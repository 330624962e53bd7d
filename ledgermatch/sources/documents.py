"""Registry and routing of uploaded files, and their column maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.operators.lists import newest_per_book

c = F.col

UPLOAD_CAP = 25 * 1024 * 1024
SNIFFED_BYTES = 2048

# File extensions.
DOC_TYPES = (("invoice", "pdf|png|jpg|jpeg"), ("gl_export", "csv|xlsx"), ("bank_statement", "ofx|qfx"))
FORMATS = (("csv", "csv"), ("xlsx", "xlsx|xls"), ("ofx", "ofx|qfx"))
MEDIA = "pdf|png|jpg|jpeg|tiff|bmp"


def _ends(path: Column, extensions: str) -> Column:
    return F.lower(path).rlike(rf"\.({extensions})$")


def route_format(path: Column, content: Column) -> Column:
    """By extension; other files that are no image or PDF by the look of their beginning."""
    out = F
    for name, extensions in FORMATS:
        out = out.when(_ends(path, extensions), name)
    # bytes, not characters; and only these few are decoded
    head = F.decode(F.substring(content.cast("binary"), 1, SNIFFED_BYTES), "ISO-8859-1")
    return (out.when(_ends(path, MEDIA), "ocr")
            .when(head.startswith("OFXHEADER") | head.startswith("<?xml"), "ofx")
            .when(head.contains(","), "csv").otherwise("ocr"))


def classified_uploads(files: DataFrame, cap: int | None = UPLOAD_CAP) -> DataFrame:
    """Document type by extension, and why a file is refused (null: accepted): its type, or more
    bytes than ``cap`` (None: no limit)."""
    out = F
    for kind, extensions in DOC_TYPES:
        out = out.when(_ends(c("path"), extensions), kind)
    too_large = F.lit(False) if cap is None else c("length") > cap
    return files.withColumn("doc_type", out).withColumn(
        "refused", F.when(c("doc_type").isNull(), "unsupported type").when(too_large, "too large"))


def register_documents(files: DataFrame, cap: int | None = UPLOAD_CAP) -> DataFrame:
    """The accepted files."""
    return classified_uploads(files, cap).filter(c("refused").isNull()).drop("refused")


def refused_documents(files: DataFrame, cap: int | None = UPLOAD_CAP) -> DataFrame:
    """The refused files with the reason, for whoever sent them."""
    return classified_uploads(files, cap).filter(c("refused").isNotNull())


def dedupe_documents_by_hash(documents: DataFrame) -> DataFrame:
    """First upload per (book, content hash) among those not deleted (S7). Only hash, id and time
    are shuffled, never the content."""
    hashed = documents.withColumn("content_hash", F.sha2(c("content").cast("binary"), 256)).drop("content")
    rest = [x for x in hashed.columns if x not in ("client_book_id", "content_hash")]
    return (hashed.filter(~F.coalesce("deleted", F.lit(False)))
            .groupBy("client_book_id", "content_hash")
            .agg(F.min_by(F.struct(*rest), F.struct("uploaded_at", "document_id")).alias("d"))
            .select("client_book_id", "content_hash", "d.*"))


def list_documents(documents: DataFrame, limit: int = 100) -> DataFrame:
    """S11."""
    return newest_per_book(documents.filter(~F.coalesce("deleted", F.lit(False))), limit,
                           F.desc("uploaded_at"), c("document_id"))


def choose_column_map(headers: DataFrame, maps: DataFrame) -> DataFrame:
    """``headers``: (document_id, client_book_id, header array); ``maps``: (map_id, client_book_id, column_map,
    created_at). The map with most source columns in the header, the newest on ties; without any hit
    the book's newest map (N10). Documents of a book without maps get an empty map."""
    scored = headers.join(maps, "client_book_id", "left").withColumn("score", F.size(F.filter(
        F.map_values("column_map"), lambda v: F.array_contains(F.transform("header", F.lower), F.lower(v)))))
    best = F.max_by(F.struct("map_id", "column_map", "score"), F.struct("score", "created_at", "map_id"))
    return scored.groupBy("document_id").agg(best.alias("m")).select(
        "document_id", "m.map_id", F.coalesce("m.column_map", F.create_map().cast("map<string,string>")).alias("column_map"),
        F.greatest("m.score", F.lit(0)).alias("score"))


# Words that suggest a target field.
ALIASES = {
    "date": ("date", "courant"),
    "amount": ("amount", "amt", "value", "total"),
    "debit": ("debit", "dr", "db"),
    "credit": ("credit", "cr", "cd"),
    "counterparty": ("counterparty", "vendor", "supplier", "payee", "customer", "name", "description"),
    "account": ("account", "gl", "code", "category"),
    "transaction_ref": ("ref", "reference", "trans", "check", "invoice"),
}


def suggest_column_map(headers: DataFrame) -> DataFrame:
    """``headers``: (document_id, position, name) -> (document_id, target, source): the first header that
    equals, contains or is part of one of the target's words (N11)."""
    words = [(t, t.replace("_", ""), False) for t in ALIASES] + [(t, a, True) for t, known in ALIASES.items() for a in known]
    known = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.lit(w).alias("word"), F.lit(p).alias("partial"))
                                for t, w, p in words)))
    # By document before the words multiply the rows: what a task sorts is its share of the documents, not of the files read.
    normal = headers.repartition("document_id").withColumn("n", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", ""))
    tried = normal.select("*", known.alias("k")).select("*", "k.*")
    hit = (c("n") == c("word")) | (c("partial") & (c("n").contains(c("word")) | c("word").contains(c("n"))))
    regular = tried.filter(hit).select("document_id", "target", "position", "name", F.lit(0).alias("rank"))
    numbered = normal.filter(c("n").rlike(r"\d") & c("n").rlike("invoice|check|ref|no|num")).select(
        "document_id", F.lit("transaction_ref").alias("target"), "position", "name", F.lit(1).alias("rank"))
    return (regular.unionByName(numbered).groupBy("document_id", "target")
            .agg(F.min_by("name", F.struct("rank", "position")).alias("source")))
