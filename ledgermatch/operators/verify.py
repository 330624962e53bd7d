"""Leg totals, variance, severity and findings of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper limit of each severity as a multiple of the book's tolerance (last: no limit).
SEVERITY_BANDS = (("info", 1), ("low", 10), ("medium", 100), ("high", None))


def group_members(groups: DataFrame, members: DataFrame, entities: DataFrame, books: DataFrame) -> DataFrame:
    """Group, member, entity and book in one row per member."""
    c = F.col
    return (members
            .join(groups.select(c("id").alias("reconciliation_group_id"), "client_book_id"), "reconciliation_group_id")
            .join(entities.select(c("id").alias("extracted_entity_id"), "amount_cents"), "extracted_entity_id")
            .join(books.select(c("id").alias("client_book_id"), "tolerance_cents"), "client_book_id"))


def group_leg_totals(rows: DataFrame) -> DataFrame:
    """Signed total and presence per leg; an absent leg totals 0 but is not present (A1)."""
    c = F.col

    def total(role: str) -> Column:
        return F.coalesce(F.sum(F.when(c("role") == role, c("amount_cents"))), F.lit(0)).cast("long")

    def present(role: str) -> Column:
        return F.coalesce(F.bool_or(c("role") == role), F.lit(False))

    return rows.groupBy("client_book_id", "reconciliation_group_id", "tolerance_cents").agg(
        *(total(r).alias(f"{r}_total") for r in ("invoice", "bank", "gl")),
        *(present(r).alias(f"has_{r}") for r in ("invoice", "bank", "gl")))


def pair_variances() -> dict[str, Column]:
    """Gap of the absolute totals for every pair of present legs, null where a leg is absent (A2)."""
    def gap(x: str, y: str) -> Column:
        return F.when(F.col(f"has_{x}") & F.col(f"has_{y}"),
                      F.abs(F.abs(f"{x}_total") - F.abs(f"{y}_total")))

    return {"invoice_bank": gap("invoice", "bank"), "invoice_gl": gap("invoice", "gl"), "bank_gl": gap("bank", "gl")}


def three_way_variance(totals: DataFrame) -> DataFrame:
    gaps = pair_variances()
    return (totals.select("*", *(g.alias(f"variance_{n}") for n, g in gaps.items()))
            .withColumn("variance_cents", F.coalesce(F.greatest(*(F.col(f"variance_{n}") for n in gaps)), F.lit(0))))


def two_set_variance(rows: DataFrame, key: str, side: Column, amount: Column) -> DataFrame:
    """abs(sum of one side - sum of the other), signed sums, an empty side is 0."""
    a = F.coalesce(F.sum(F.when(side, amount)), F.lit(0))
    b = F.coalesce(F.sum(F.when(~side, amount)), F.lit(0))
    return rows.groupBy(key).agg(F.abs(a - b).cast("long").alias("variance_cents"))


def tolerance_check(variance: Column, tolerance: Column) -> Column:
    """Strictly greater."""
    return variance > tolerance


def tolerance_greater_of(fixed: Column, share: Column, total: Column) -> Column:
    """The larger of fixed cents and share*total (currency units), half-even to a cent."""
    return F.bround(F.greatest(fixed.cast("decimal(38,8)"), (share * total * 100).cast("decimal(38,8)")), 0).cast("long")


def severity(variance: Column, tolerance: Column, bands=SEVERITY_BANDS) -> Column:
    v, chain = F.abs(variance), F
    for label, multiple in bands:
        if multiple is None:
            return chain.otherwise(label)
        chain = chain.when(v <= tolerance * multiple, label)
    return chain


def severity_from_table(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Severity by a threshold table (severity, upto: multiple of the tolerance, null = no limit).

    The table is folded to one array and read as a scalar subquery: no join with the rows.
    """
    c = F.col
    table = bands.agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce("upto", F.lit(2**31)).alias("upto"), "severity"))).alias("table")).scalar()
    first = F.filter("_bands", lambda b: (F.abs(c("variance_cents")) <= c("tolerance_cents") * b["upto"])
                     | (b["upto"] == F.lit(2**31)))
    return rows.withColumn("_bands", table).withColumn("severity", first[0]["severity"]).drop("_bands")


def formula_text(label: Column, invoice: Column, bank: Column, gl: Column, variance: Column, tolerance: Column) -> Column:
    """Calculation as text, cents with two decimals, an absent leg as 0.00."""
    return F.format_string("%s: invoice=%d.00, bank=%d.00, gl=%d.00, variance=%d.00, tolerance=%d",
                           label, invoice, bank, gl, variance, tolerance)


def rule_version(rule: Column) -> Column:
    """First 16 hex digits of the rule text's SHA-256."""
    return F.substring(F.sha2(rule.cast("binary"), 256), 1, 16)


def _evaluated(totals: DataFrame, label: Column, rule_id: str, rule: str) -> DataFrame:
    c = F.col

    def shown(leg: str) -> Column:
        return F.when(c(f"has_{leg}"), c(f"{leg}_total")).otherwise(F.lit(0))

    v, t = c("variance_cents"), c("tolerance_cents")
    return three_way_variance(totals).select(
        "client_book_id", "reconciliation_group_id", F.lit(rule_id).alias("rule_id"),
        rule_version(F.lit(rule)).alias("rule_version"), v.alias("calculated_variance_cents"), t.alias("tolerance_cents"),
        tolerance_check(v, t).alias("exceeds_tolerance"),
        formula_text(label, shown("invoice"), shown("bank"), shown("gl"), v, t).alias("calculation_formula"),
        severity(v, t).alias("severity"))


def evaluate_groups(totals: DataFrame, rule_id: str = "gl_reconciliation", rule: str = "{}") -> DataFrame:
    """One finding per group."""
    return _evaluated(totals, F.concat(F.lit("Group "), F.col("reconciliation_group_id")), rule_id, rule)


def evaluate_single(totals: DataFrame, rule_id: str = "gl_reconciliation", rule: str = "{}") -> DataFrame:
    """The same verdict under the fixed title of a single check."""
    return _evaluated(totals, F.lit("GL Reconciliation"), rule_id, rule)
