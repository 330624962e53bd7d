"""Date texts to dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermatch.functions.text import strip

# Accepted layouts in order of preference, as (shape, pattern).
STRUCTURED = (
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{2}", "M/d/yy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{2}", "d/M/yy"),
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
)
VERBATIM = STRUCTURED[:3]
LINE = (
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"\d{2}/\d{2}/\d{4}", "MM/dd/yyyy"),
    (r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy"),
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{2}/\d{2}/\d{2}", "MM/dd/yy"),
    (r"\d{2}/\d{2}/\d{2}", "dd/MM/yy"),
    (r"\d{2}-\d{2}-\d{4}", "MM-dd-yyyy"),
    (r"\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy"),
)


def _parse(text: Column, pattern: str) -> Column:
    """Two-digit years from 70 on belong to the last century."""
    day = F.try_to_date(text, pattern)
    if "yyyy" in pattern:
        return day
    return F.when(F.year(day) >= 2070, F.add_months(day, -1200)).otherwise(day)


def _first(text: Column, layouts) -> Column:
    """Shape test before parsing: years keep their stated number of digits."""
    return F.coalesce(*(_parse(F.when(text.rlike(f"^{shape}$"), text), pattern) for shape, pattern in layouts))


def date_structured(text: Column) -> Column:
    """Quotes are trimmed and a timestamp of 14 or more digits is cut to its day."""
    def once(value: Column, use) -> Column:
        """``use`` of a value that is computed once, however often it occurs in there."""
        return F.transform(F.array(value), use)[0]

    t = F.regexp_replace(strip(text), r"^\"+|\"+$", "")
    t = F.regexp_replace(t, r"^'+|'+$", "")
    return once(t, lambda t: once(F.when(t.rlike(r"^\d{14,}$"), F.substring(t, 1, 8)).otherwise(t), lambda day: _first(day, STRUCTURED)))


def date_verbatim(text: Column) -> Column:
    """N6."""
    return _first(text, VERBATIM)


def line_date(text: Column) -> Column:
    """The first readable date inside a line, by layout and then by position (N7). A date is not
    bounded by another digit or date separator on either side."""
    def layout(shape: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(rf"(?<![0-9/.\-])({shape})(?![0-9/.\-])"), F.lit(1))
        dates = F.filter(F.transform(hits, lambda h: _parse(h, pattern)), lambda d: d.isNotNull())
        return F.try_element_at(dates, F.lit(1))

    # most lines hold no digits: spare them the eight searches
    return F.when(text.rlike(r"\d"), F.coalesce(*(layout(s, p) for s, p in LINE)))
