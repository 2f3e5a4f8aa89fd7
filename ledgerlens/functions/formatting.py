"""Display formats (F1–F9) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schema import WEEKDAY_NAMES

# Date layouts shown by the reference.
ISO_DATE = "yyyy-MM-dd"          # F1  2024-01-05
LONG_DATE = "MMM dd, yyyy"       # F2  Jan 05, 2024
MONTH_LABEL = "MMM yyyy"         # F3  Jan 2024
MONTH_AXIS = "MMM"               # F4  Jan


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_date(c: Column | str) -> Column:
    return F.date_format(_col(c), ISO_DATE)


def long_date(c: Column | str) -> Column:
    return F.date_format(_col(c), LONG_DATE)


def month_label(month: Column | str) -> Column:
    """'2024-01' → 'Jan 2024'."""
    return F.date_format(F.to_date(F.concat(_col(month), F.lit("-01"))), MONTH_LABEL)


def month_axis(month: Column | str) -> Column:
    """'2024-01' → 'Jan'."""
    return F.date_format(F.to_date(F.concat(_col(month), F.lit("-01"))), MONTH_AXIS)


def month_start(date: Column | str) -> Column:
    """first day of the date's month (DATE)."""
    return F.trunc(_col(date), "month")


def day_span(first: Column | str, last: Column | str) -> Column:
    """whole days from ``first`` to ``last``."""
    return F.datediff(_col(last), _col(first))


def weekday_index(date: Column | str) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(_col(date))


def weekday_name(dow: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), _col(dow) + 1)


def _plain_number(v: Column, digits: int) -> Column:
    # format_number rounds the exact binary value half-even, like Python's
    # float formatting; drop its grouping commas where Python has none.
    return F.regexp_replace(F.format_number(v, digits), ",", "")


def fmt_compact(v: Column | str) -> Column:
    """F8: ≥1M → '$1.2M', ≥1k → '$12k', else '$1,234' (Python rounding)."""
    x = _col(v).cast("double")
    a = F.abs(x)
    return (
        F.when(a >= 1_000_000, F.concat(F.lit("$"), _plain_number(x / 1_000_000, 1), F.lit("M")))
        .when(a >= 1_000, F.concat(F.lit("$"), _plain_number(x / 1_000, 0), F.lit("k")))
        .otherwise(F.concat(F.lit("$"), F.format_number(x, 0)))
    )


def fmt_currency(v: Column | str, digits: int = 2) -> Column:
    """browser currency text, '-$1,234.56' for negatives. Halves round
    away from zero, as the browser does; pass DECIMAL input for exactness."""
    x = _col(v)
    mag = F.format_number(F.round(F.abs(x), digits), digits)
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), mag)
