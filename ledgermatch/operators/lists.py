"""List views, filters and small lookups (F*, S11, J7-J15). Every ordered list ends in the id, so
equal sort values still give one result; limits are the reports' own page sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

c = F.col


def newest_per_book(rows: DataFrame, limit: int, *order: Column, book: str = "client_book_id") -> DataFrame:
    """The first ``limit`` rows of every book. Spark prunes each partition to the limit before the
    shuffle (window group limit), so a busy book does not travel whole."""
    rank = F.row_number().over(Window.partitionBy(book).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(c("_rank") <= limit).drop("_rank")


def list_entities(entities: DataFrame, entity_type: str | None = None, date_from=None, date_to=None,
                  source_format: str | None = None, limit: int = 100) -> DataFrame:
    """F1, for every book at once."""
    if entity_type:
        entities = entities.filter(c("entity_type") == entity_type)
    if date_from:
        entities = entities.filter(c("transaction_date") >= F.lit(date_from).cast("date"))
    if date_to:
        entities = entities.filter(c("transaction_date") <= F.lit(date_to).cast("date"))
    if source_format:
        entities = entities.filter(c("source_format") == source_format)
    shown = newest_per_book(entities, limit, F.desc_nulls_last("transaction_date"), c("id"))
    return shown.withColumn("transaction_date", F.coalesce("transaction_date", F.to_date(F.lit("1970-01-01"))))


def list_findings(findings: DataFrame, severity: str | None = None, status: str | None = None,
                  limit: int = 25) -> DataFrame:
    """F2."""
    if severity:
        findings = findings.filter(c("severity") == severity)
    if status:
        findings = findings.filter(c("status") == status)
    return newest_per_book(findings, limit, F.desc("created_on"), c("reconciliation_group_id"))


def pending_entities(entities: DataFrame, members: DataFrame, document: str | None = None) -> DataFrame:
    """Entities in no group, whatever the group's status (F3). No row cap: linking needs them all."""
    if document:
        entities = entities.filter(c("source_document_id") == document)
    return entities.join(members.select(c("extracted_entity_id").alias("id")), "id", "left_anti")


def visible_books(users: DataFrame, books: DataFrame, assignments: DataFrame) -> DataFrame:
    """(user_id, client_book_id): admins see their firm's books, staff only assigned ones of it."""
    owned = books.select(c("id").alias("client_book_id"), "firm_id")
    admin = (users.filter(c("role") == "firm_admin").select(c("id").alias("user_id"), "firm_id")
             .join(owned, "firm_id").select("user_id", "client_book_id"))
    staff = (users.filter(c("role") != "firm_admin").select(c("id").alias("user_id"), "firm_id")
             .join(assignments, "user_id").join(owned, ["client_book_id", "firm_id"], "left_semi")
             .select("user_id", "client_book_id"))
    return admin.unionByName(staff)


BOOK_BUCKETS = 64  # folders of a table that is stored by book


def book_bucket(book: str = "client_book_id"):
    return F.pmod(F.xxhash64(book), F.lit(BOOK_BUCKETS)).cast("int")


def store_by_book(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` written into a folder per bucket of books, and read again with that column as ``book_bucket``."""
    stored = rows.withColumn("book_bucket", book_bucket())
    stored.repartition("book_bucket").write.partitionBy("book_bucket").parquet(path)
    return rows.sparkSession.read.schema(stored.schema).parquet(path)


def tenant_scope(rows: DataFrame, visible: DataFrame, users: list[str]) -> DataFrame:
    """Rows of books that any of ``users`` may see. Of a table stored by book only their buckets' folders are read: the
    bucket is a join key, which Spark turns into a partition filter once it knows the books."""
    mine = visible.filter(c("user_id").isin(users)).select("client_book_id")
    if "book_bucket" not in rows.columns:
        return rows.join(mine, "client_book_id", "left_semi")
    return rows.join(mine.withColumn("book_bucket", book_bucket()), ["book_bucket", "client_book_id"], "left_semi")


def reminders_due(requests: DataFrame, periods: DataFrame, as_of: str, age_days: int = 5) -> DataFrame:
    """Pending, fewer than three reminders, period waiting to close, old enough."""
    closing = periods.filter(c("status") == "pending_close").select(
        c("id").alias("reconciliation_period_id"), "period_start", "period_end")
    return (requests.filter((c("status") == "pending") & (c("reminder_sent_count") < 3)
                            & (c("requested_on") <= F.date_sub(F.lit(as_of).cast("date"), age_days)))
            .join(closing, "reconciliation_period_id"))


def increment_reminders(requests: DataFrame, due: DataFrame) -> DataFrame:
    """All requests, the due ones with one reminder more (M7)."""
    hit = due.select("id", F.lit(1).alias("_due")).distinct()
    return (requests.join(hit, "id", "left")
            .withColumn("reminder_sent_count", c("reminder_sent_count") + F.coalesce("_due", F.lit(0))).drop("_due"))


def alertable_findings(findings: DataFrame, books: DataFrame, devices: DataFrame, as_of: str) -> DataFrame:
    """High findings x the firm's devices seen within 90 days with a well-formed token."""
    usable = devices.filter(F.length("token").between(22, 150) & ~c("token").rlike(r"[ \t\r\n]")
                            & (c("last_seen_on") > F.date_sub(F.lit(as_of).cast("date"), 90)))
    firm = books.select(c("id").alias("client_book_id"), "firm_id")
    return findings.filter(c("severity") == "high").join(firm, "client_book_id").join(
        usable.select("firm_id", "token"), "firm_id")


def matching_subscriptions(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Enabled subscriptions of the event's firm that list its type."""
    listed = (subscriptions.filter("enabled")
              .select(c("id").alias("subscription_id"), "firm_id", F.explode(F.array_distinct("event_types")).alias("event_type")))
    return events.join(listed, ["firm_id", "event_type"])


def enum_violations(rows: DataFrame, rules: dict[str, tuple[str, ...]], key: str = "id") -> DataFrame:
    """Rows whose coded column holds a value outside its list (F14): key, column_name, value."""
    checks = F.array(*(F.when(c(col).isNotNull() & ~c(col).isin(*allowed),
                              F.struct(F.lit(col).alias("column_name"), c(col).cast("string").alias("value")))
                       for col, allowed in rules.items()))
    return (rows.select(key, F.explode(checks).alias("v")).filter(c("v").isNotNull())
            .select(key, "v.column_name", "v.value"))


# The permitted codes of the model's coded columns.
ENUMS = {
    "entity_type": ("invoice_line_item", "bank_transaction", "gl_entry"),
    "entity_subtype": ("standard", "credit_note", "refund", "void"),
    "debit_or_credit": ("debit", "credit"),
    "source_format": ("ocr", "structured", "manual"),
}

# The permitted codes of the other stored tables.
STORED_ENUMS = {
    "books": {"tolerance_mode": ("fixed", "percentage", "greater_of")},
    "users": {"role": ("firm_admin", "staff")},
    "documents": {"doc_type": ("invoice", "bank_statement", "gl_export"), "ocr_status": ("pending", "processing", "done", "failed")},
    "groups": {"status": ("auto_linked", "needs_review", "confirmed", "rejected")},
    "members": {"role": ("invoice", "bank", "gl")},
    "findings": {"severity": ("info", "low", "medium", "high"), "status": ("open", "acknowledged", "resolved")},
    "periods": {"status": ("open", "pending_close", "closed", "reopened")},
    "accounts": {"account_type": ("asset", "liability", "equity", "revenue", "expense")},
    "requests": {"status": ("pending", "fulfilled", "waived")},
}


def stored_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """F14 over whole tables by name (each with an ``id``): table_name, id, column_name, value. A table's columns that it
    lacks are not looked at; no table is shuffled."""
    found = []
    for name, rows in tables.items():
        rules = {col: allowed for col, allowed in STORED_ENUMS[name].items() if col in rows.columns}
        found.append(enum_violations(rows, rules).select(F.lit(name).alias("table_name"), "id", "column_name", "value"))
    return reduce(DataFrame.unionByName, found)


def ordered(rows: DataFrame, *order) -> DataFrame:
    """Dimension lists in their display order."""
    return rows.orderBy(*order)


def bulk_confirm_candidates(groups: DataFrame, floor: float = 0.95) -> DataFrame:
    """Queue rows above the confidence that the bulk action offers."""
    return groups.filter((c("status") == "needs_review") & (c("link_confidence") > floor))


def review_queue(groups: DataFrame, members: DataFrame, status: str = "needs_review", limit: int = 100) -> DataFrame:
    """Newest queue rows of a book with one entity id per role, '' if none."""
    shown = newest_per_book(groups.filter(c("status") == status), limit, F.desc("created_on"), c("id"))
    one = (members.groupBy("reconciliation_group_id")
           .agg(*(F.min(F.when(c("role") == r, c("extracted_entity_id"))).alias(f"{r}_entity_id")
                  for r in ("invoice", "bank", "gl"))))
    return (shown.join(one, shown["id"] == one["reconciliation_group_id"], "left").drop("reconciliation_group_id")
            .fillna("", [f"{r}_entity_id" for r in ("invoice", "bank", "gl")]))


def group_scope(members: DataFrame, entities: DataFrame, accounts: DataFrame) -> DataFrame:
    """'ar' if any ledger leg posts to an asset or revenue account (by code or by name) or its
    account text speaks of checking, cash or receivable, else 'ap' (J12).

    Two equi-joins instead of one OR-join, which could only run as a nested loop.
    """
    legs = (members.filter(c("role") == "gl")
            .join(entities.select(c("id").alias("extracted_entity_id"), "client_book_id", "gl_account_code"),
                  "extracted_entity_id"))
    good = accounts.filter(c("account_type").isin("asset", "revenue"))
    by_code = good.select("client_book_id", c("account_code").alias("gl_account_code"))
    by_name = good.select("client_book_id", c("account_name").alias("gl_account_code"))
    known = by_code.unionByName(by_name).distinct().withColumn("_known", F.lit(True))
    text = F.lower("gl_account_code")
    spoken = text.contains("checking") | text.contains("cash") | text.contains("receivable")
    return (legs.join(known, ["client_book_id", "gl_account_code"], "left")
            .groupBy("reconciliation_group_id")
            .agg(F.coalesce(F.bool_or(c("_known") | spoken), F.lit(False)).alias("ar"))
            .select("reconciliation_group_id", F.when(c("ar"), "ar").otherwise("ap").alias("group_scope")))


def canonical_counterparty(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """The book's canonical name for a known alias, else the name itself."""
    known = aliases.groupBy("client_book_id", F.lower("alias").alias("_alias")).agg(
        F.min("canonical_name").alias("canonical_name"))
    return (entities.withColumn("_alias", F.lower("counterparty"))
            .join(known, ["client_book_id", "_alias"], "left")
            .withColumn("canonical", F.coalesce("canonical_name", "counterparty")).drop("_alias", "canonical_name"))


def superseded_entities(entities: DataFrame, corrections: DataFrame) -> DataFrame:
    """Status of every entity after manual corrections."""
    hit = corrections.select(c("corrects_entity_id").alias("id")).filter("id is not null").distinct().withColumn("_hit", F.lit(True))
    return (entities.join(hit, "id", "left")
            .withColumn("status", F.when(c("_hit"), "superseded_by_manual").otherwise("active")).drop("_hit"))
