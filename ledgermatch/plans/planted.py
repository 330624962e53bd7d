"""Test data with a known answer (R12): of every seven rows three agree exactly, two lie within the
book's tolerance and two differ so much that they must be found as high."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def plant_discrepancies(sales: DataFrame) -> DataFrame:
    """``sales``: (client_book_id, k, tol, cents) -> with kind, bank_cents (negative) and gl_cents."""
    turn = c("k") % 7
    kind = F.when(turn < 3, "exact").when(turn < 5, "within").otherwise("high")
    gap = F.when(turn < 3, 0).when(turn < 5, c("tol")).otherwise(c("tol") * 101)
    return sales.withColumn("kind", kind).withColumn("bank_cents", -c("cents")).withColumn("gl_cents", c("cents") + gap)
