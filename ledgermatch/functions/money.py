"""Amount texts to integer cents, as column expressions.

No text aborts a job: digits that do not fit into a long are unreadable like any other text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermatch.functions.text import strip

_NUMBER = r"^[+-]?(?=.*[0-9])[0-9]*\.?[0-9]*$"


def _cents(digits: Column) -> Column:
    """A plain decimal number to cents, half away from zero."""
    return F.round(digits.try_cast("double") * 100).try_cast("long")


def amount_structured(text: Column) -> Column:
    """CSV, sheet and statement amounts (N1): "100" is 100 currency units, parentheses do not negate,
    a sign inside the number makes it unreadable (null)."""
    kept = F.regexp_replace(text, r"[^0-9.+\-]", "")
    return _cents(F.when(kept.rlike(_NUMBER), kept))


def _verbatim_magnitude(text: Column) -> Column:
    kept = F.regexp_replace(text, r"[^0-9.]", "")
    readable = kept.rlike(r"^(?=.*[0-9])[0-9]*\.?[0-9]*$")
    pointed = kept.contains(".")
    fraction = F.bround(F.when(readable & pointed, kept).try_cast("double") * 100).try_cast("long")
    whole = F.when(readable & ~pointed, kept).try_cast("long")
    return F.coalesce(fraction, whole, F.lit(0).cast("long"))


def amount_verbatim(text: Column) -> Column:
    """Amount strings as printed on a page (N2): a leading minus or enclosing parentheses negate; only
    text with a decimal point is scaled ("1250" is already cents); unreadable text is 0."""
    t = strip(text)
    negative = t.startswith("-") | (t.startswith("(") & t.endswith(")"))
    magnitude = _verbatim_magnitude(t)
    return F.when(negative, -magnitude).otherwise(magnitude)


def amount_citation(text: Column) -> Column:
    """As printed, without its sign (N3); a missing or blank text is 0."""
    return F.coalesce(_verbatim_magnitude(strip(text)), F.lit(0).cast("long"))


def line_amount(text: Column) -> Column:
    """The largest currency-shaped value of a line, the last of equals.

    Only runs of digits, commas, dots, dollar signs and dashes with exactly two decimals count; a
    run is negative when it starts with a dash.
    """
    runs = F.regexp_extract_all(text, F.lit(r"([0-9.,$\-]+)"), F.lit(1))
    cores = F.transform(runs, lambda r: F.struct(
        r.startswith("-").alias("negative"),
        F.regexp_replace(F.regexp_replace(r, r"^[$\-]+", ""), r"[,$]", "").alias("core")))
    money = F.filter(cores, lambda x: x["core"].rlike(r"^[0-9]+\.[0-9]{2}$"))
    # two decimals exactly: without the point the digits are the cents
    values = F.transform(money, lambda x: F.regexp_replace(x["core"], r"\.", "").try_cast("long")
                         * F.when(x["negative"], -1).otherwise(1))
    values = F.filter(values, lambda v: v.isNotNull())
    largest = F.aggregate(values, F.lit(None).cast("long"), lambda best, v: F.when(
        best.isNull() | (F.abs(v) >= F.abs(best)), v).otherwise(best))
    return F.when(text.rlike(r"\d"), largest)  # most lines hold no digits at all


def resolve_debit_credit(mapped: Column, sides: list[Column]) -> Column:
    """The mapped amount text unless blank, else the first side that is not blank, else '' (N8)."""
    def filled(x: Column) -> Column:
        return F.when(strip(x) != "", x)

    return F.coalesce(filled(mapped), *(filled(s) for s in sides), F.lit(""))


def format_cents(cents: Column) -> Column:
    """US currency text: $1,234.50, -$0.05."""
    text = F.concat(F.lit("$"), F.format_number(F.abs(cents) / F.lit(100), 2))
    return F.when(cents < 0, F.concat(F.lit("-"), text)).otherwise(text)
