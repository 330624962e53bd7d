"""Equi-join keys for the inexact conditions (amount band, date window, optional values).

Every helper is lossless and yields each true pair exactly once, because only one side of a
condition is expanded; the exact condition stays in the join as a residual.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOOKBACK_DAYS = 14   # an invoice may precede its payment by this much
TIGHT_DAYS = 3       # instalments lie this close together

_UNDATED = -1_000_001   # partner without a date
_ANY_DATE = -1_000_002  # this row has no date: meets every partner


def amounts_match(a: Column, b: Column, tolerance: Column) -> Column:
    """Equal within tolerance by absolute value: the sign only says which side booked it."""
    return F.abs(F.abs(a) - F.abs(b)) <= tolerance


def dates_match(earlier: Column, later: Column) -> Column:
    gap = F.datediff(later, earlier)
    return earlier.isNull() | later.isNull() | gap.between(0, LOOKBACK_DAYS)


def dates_within(first: Column, last: Column, days: int = TIGHT_DAYS) -> Column:
    """The known dates of a combination lie close together; fewer than two always do."""
    return F.coalesce(F.datediff(last, first) <= days, F.lit(True))


def band_width(tolerance: Column) -> Column:
    # several tolerances wide: a searched range then touches one band mostly, two at worst
    return 8 * (tolerance + 1)


def band(amount: Column, tolerance: Column) -> Column:
    return F.floor(amount / band_width(tolerance))


def bands(low: Column, high: Column, tolerance: Column) -> Column:
    return F.sequence(F.floor(low / band_width(tolerance)), F.floor(high / band_width(tolerance)))


def amount_band(amount: Column, tolerance: Column) -> Column:
    return band(F.abs(amount), tolerance)


def amount_bands(amount: Column, tolerance: Column) -> Column:
    return bands(F.abs(amount) - tolerance, F.abs(amount) + tolerance, tolerance)


def power_of_two(amount: Column) -> Column:
    """The band of an amount other than zero whose width doubles with it."""
    return F.floor(F.log2(F.abs(amount).cast("double"))).cast("int")


POWERS = 4  # powers of two in a band: a searched range touches one band mostly, two at worst


def power_band(amount: Column) -> Column:
    return F.floor(power_of_two(amount) / POWERS).cast("int")


def neighbouring_power_bands(amount: Column) -> Column:
    """Bands of all amounts between half and twice of this one."""
    own = power_of_two(amount)
    return F.array_distinct(F.transform(F.array(own - 1, own + 1), lambda p: F.floor(p / POWERS).cast("int")))


def _day(date: Column) -> Column:
    return F.unix_date(date)


def earlier_date_keys(date: Column, days: int = LOOKBACK_DAYS) -> Column:
    b = F.floor(_day(date) / F.lit(days + 1)).cast("int")
    return F.when(date.isNull(), F.array(F.lit(_ANY_DATE))).otherwise(
        F.array(b, b + 1, F.lit(_UNDATED)))


def later_date_keys(date: Column, days: int = LOOKBACK_DAYS) -> Column:
    b = F.floor(_day(date) / F.lit(days + 1)).cast("int")
    return F.when(date.isNull(), F.array(F.lit(_UNDATED), F.lit(_ANY_DATE))).otherwise(
        F.array(b, F.lit(_ANY_DATE)))


def preceding_date_keys(date: Column, days: int = LOOKBACK_DAYS) -> Column:
    """Partner of ``later_date_keys`` on the earlier side, if the later side is the one to expand."""
    b = F.floor(_day(date) / F.lit(days + 1)).cast("int")
    return F.when(date.isNull(), F.array(F.lit(_ANY_DATE))).otherwise(
        F.array(b - 1, b, F.lit(_UNDATED)))


def near_date_keys(date: Column, days: int = TIGHT_DAYS) -> Column:
    """Partner of ``later_date_keys`` for a symmetric window: one band to either side."""
    b = F.floor(_day(date) / F.lit(days + 1)).cast("int")
    return F.when(date.isNull(), F.array(F.lit(_ANY_DATE))).otherwise(
        F.array(b - 1, b, b + 1, F.lit(_UNDATED)))
