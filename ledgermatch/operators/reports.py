"""Finding reports, dashboards and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.operators.lists import newest_per_book
from ledgermatch.operators.numbering import numbered
from ledgermatch.operators.verify import SEVERITY_BANDS

c = F.col
SEVERITIES = [label for label, _ in SEVERITY_BANDS]

# Business days until a finding is due.
DUE_DAYS = {"high": 2, "medium": 7, "low": 30}


def _severity_rows(like: DataFrame) -> DataFrame:
    """The four severities as rows, spanned over one row of distinct keys per group."""
    return like.select("*", F.explode(F.array(*(F.lit(s) for s in SEVERITIES))).alias("severity"))


def finding_citation(findings: DataFrame, members: DataFrame, entities: DataFrame) -> DataFrame:
    """Source document, page and box behind each finding: invoice before bank before ledger.

    The best member is an aggregate (combined map-side), not a sorted window.
    """
    source = entities.select(c("id").alias("extracted_entity_id"), "source_document_id", "page_number",
                             "box_x", "box_y", "box_w", "box_h")
    rank = F.when(c("role") == "invoice", 0).when(c("role") == "bank", 1).otherwise(2)
    best = members.groupBy("reconciliation_group_id").agg(
        F.min_by("extracted_entity_id", F.struct(rank.alias("r"), "extracted_entity_id")).alias("extracted_entity_id"))
    return (findings.select("reconciliation_group_id", "rule_id", "rule_version")
            .join(best, "reconciliation_group_id").join(source, "extracted_entity_id"))


def report_members(rows: DataFrame, citations: DataFrame, key: str = "reconciliation_group_id") -> DataFrame:
    """Citations of findings that a report lists (rows: see ``report_rows``)."""
    return citations.join(rows.select(key), key, "left_semi")


def findings_in_period(findings: DataFrame, members: DataFrame, entities: DataFrame, start: str, end: str) -> DataFrame:
    """Findings with any member dated inside the period, end day included."""
    dated = entities.filter(c("transaction_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    touched = members.join(dated.select(c("id").alias("extracted_entity_id")), "extracted_entity_id", "left_semi")
    return findings.join(touched.select("reconciliation_group_id"), "reconciliation_group_id", "left_semi")


_REPORT = ["id", "client_book_id", "period_start", "period_end"]


def report_rows(listed: DataFrame) -> DataFrame:
    """The reports' findings as rows: report, position from 0 (newest first), reconciliation_group_id, findings (of the
    report). ``listed``: a report's columns, reconciliation_group_id, created_on. No task holds a report."""
    aged = listed.select(*_REPORT, (-F.unix_date("created_on")).alias("age"), "reconciliation_group_id")
    return numbered(aged, _REPORT, ["age", "reconciliation_group_id"], "position", "findings").drop("age")


def assembled(rows: DataFrame) -> DataFrame:
    """Whole reports, a row with the array of finding ids each: what one reader of one report asks for."""
    found = F.sort_array(F.collect_list(F.struct("position", c("reconciliation_group_id").alias("id"))))
    return rows.groupBy(*_REPORT).agg(F.transform(found, lambda x: x["id"]).alias("finding_ids"))


def period_report(findings: DataFrame, start: str, end: str) -> DataFrame:
    """One report row per book with its finding ids, newest first."""
    listed = findings.withColumns({"id": F.concat(F.lit("report:"), "client_book_id"), "period_start": F.lit(start).cast("date"),
                                   "period_end": F.lit(end).cast("date")})
    return assembled(report_rows(listed)).drop("id")


def severity_tally(findings: DataFrame) -> DataFrame:
    """Findings per book and severity, all four listed."""
    counted = findings.groupBy("client_book_id", "severity").agg(F.count("*").alias("n"))
    return (_severity_rows(findings.select("client_book_id").distinct())
            .join(counted, ["client_book_id", "severity"], "left").fillna(0, ["n"]))


def automation_rate(groups: DataFrame, books: DataFrame) -> DataFrame:
    """Share of groups linked without a reviewer; books without groups rate 0 (A5)."""
    s = c("status")
    rates = groups.groupBy("client_book_id").agg(
        F.count_if(s == "auto_linked").alias("auto_linked"), F.count_if(s == "needs_review").alias("needs_review"),
        F.count_if(s == "confirmed").alias("confirmed"), F.count("*").alias("total"))
    return (books.select(c("id").alias("client_book_id")).join(rates, "client_book_id", "left")
            .fillna(0, ["auto_linked", "needs_review", "confirmed", "total"])
            .withColumn("automation_rate", F.coalesce(F.try_divide("auto_linked", "total"), F.lit(0.0))))


def due_on(created_on: Column, severity: Column) -> Column:
    """Creation day plus the severity's days plus two weekend days per full week of them."""
    d = F.lit(0)
    for label, days in DUE_DAYS.items():
        d = F.when(severity == label, days).otherwise(d)
    return F.date_add(created_on, (d + F.floor(2 * d / F.lit(7))).cast("int"))


def past_due(as_of: str) -> Column:
    # due at midnight of its day: past due from the very next moment
    return due_on(c("created_on"), c("severity")).cast("timestamp") < F.lit(as_of).cast("timestamp")


def _open(findings: DataFrame, books: DataFrame) -> DataFrame:
    firm = books.select(c("id").alias("client_book_id"), "firm_id")
    return findings.filter(c("status") == "open").join(firm, "client_book_id")


def open_findings_by_severity(findings: DataFrame, books: DataFrame) -> DataFrame:
    """Per firm, zero-filled."""
    counted = _open(findings, books).groupBy("firm_id", "severity").agg(F.count("*").alias("n"))
    return (_severity_rows(books.select("firm_id").distinct())
            .join(counted, ["firm_id", "severity"], "left").fillna(0, ["n"]))


def past_due_findings(findings: DataFrame, books: DataFrame, as_of: str) -> DataFrame:
    """Open findings past their due day, per firm."""
    counted = _open(findings, books).filter(past_due(as_of)).groupBy("firm_id").agg(F.count("*").alias("past_due"))
    return books.select("firm_id").distinct().join(counted, "firm_id", "left").fillna(0, ["past_due"])


def avg_resolution_seconds(findings: DataFrame, books: DataFrame, as_of: str) -> DataFrame:
    """Mean time from creation to review over the last 30 days, per firm (A8); days or moments, to the second."""
    seconds = c("reviewed_on").cast("timestamp").cast("double") - c("created_on").cast("timestamp").cast("double")
    firm = books.select(c("id").alias("client_book_id"), "firm_id")
    return (findings.filter(c("reviewed_on") >= F.date_sub(F.lit(as_of).cast("date"), 30))
            .join(firm, "client_book_id").groupBy("firm_id")
            .agg(F.avg(seconds).alias("avg_resolution_seconds")))


def book_breakdown(findings: DataFrame, books: DataFrame, as_of: str) -> DataFrame:
    """Open and past-due findings of every book, books without any included."""
    counted = findings.filter(c("status") == "open").groupBy("client_book_id").agg(
        F.count("*").alias("open_findings"), F.count_if(past_due(as_of)).alias("past_due"))
    return (books.select("firm_id", c("id").alias("client_book_id"), "client_name")
            .join(counted, "client_book_id", "left").fillna(0, ["open_findings", "past_due"]))


def stale_requests(requests: DataFrame, books: DataFrame) -> DataFrame:
    """Pending requests with three or more reminders, per firm (A10)."""
    firm = books.select(c("id").alias("client_book_id"), "firm_id")
    counted = (requests.filter((c("status") == "pending") & (c("reminder_sent_count") >= 3))
               .join(firm, "client_book_id").groupBy("firm_id").agg(F.count("*").alias("stale_requests")))
    return books.select("firm_id").distinct().join(counted, "firm_id", "left").fillna(0, ["stale_requests"])


def firm_dashboard(findings: DataFrame, requests: DataFrame, books: DataFrame, as_of: str) -> DataFrame:
    """One row per firm (A11). Findings are read and shuffled once for all their figures."""
    firm = books.select(c("id").alias("client_book_id"), "firm_id")
    is_open = c("status") == "open"
    recent = c("reviewed_on") >= F.date_sub(F.lit(as_of).cast("date"), 30)
    figures = findings.join(firm, "client_book_id").groupBy("firm_id").agg(
        F.count_if(is_open).alias("total_open"),
        *(F.count_if(is_open & (c("severity") == s)).alias(f"open_{s}") for s in SEVERITIES),
        F.count_if(is_open & past_due(as_of)).alias("past_due"),
        F.avg(F.when(recent, F.datediff("reviewed_on", "created_on") * F.lit(86400.0))).alias("avg_resolution_seconds"))
    counts = ["total_open", *(f"open_{s}" for s in SEVERITIES), "past_due"]
    return stale_requests(requests, books).join(figures, "firm_id", "left").fillna(0, counts)


def portal_reports(rows: DataFrame, limit: int = 50) -> DataFrame:
    """Newest reports of each book with the number of findings (F10), from the rows of ``report_rows``."""
    reports = rows.filter("position = 0").select(*_REPORT, "findings")
    return newest_per_book(reports, limit, F.desc("period_end"), c("id"))


def portal_findings(findings: DataFrame, limit: int = 100) -> DataFrame:
    return newest_per_book(findings, limit, F.desc("created_on"), c("reconciliation_group_id")).select(
        "client_book_id", "reconciliation_group_id", "severity", "status", "rule_id", "calculation_formula")


def monthly_reports(findings: DataFrame, members: DataFrame, entities: DataFrame, periods: DataFrame) -> DataFrame:
    """The rows of the period report of every book and period, in one job."""
    from ledgermatch.operators.periods import entity_periods

    dated = members.join(entities.select(c("id").alias("extracted_entity_id"), "client_book_id", "transaction_date"),
                         "extracted_entity_id")
    touched = entity_periods(dated, periods).select("reconciliation_group_id", "period_id", "period_start", "period_end").distinct()
    return report_rows(findings.join(touched, "reconciliation_group_id").withColumn("id", F.concat(F.lit("report:"), "period_id")))


def get_report(rows: DataFrame) -> DataFrame:
    """Whole reports with their dates as text."""
    return assembled(rows).select("id", "client_book_id", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"),
                          F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), "finding_ids")
