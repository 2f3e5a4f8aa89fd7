"""Coercion of raw export text into typed columns (P4, P5). Unparseable
input becomes NULL instead of failing the job (ANSI mode is on)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schema import AMOUNT_TYPE

# Fixed value: day-grain date layout of both export dialects. One-digit
# month/day are accepted, as the reference's parser accepts them.
DATE_PATTERN = "yyyy-M-d"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: Column | str) -> Column:
    """Text → DATE; anything that is not a plain day (time part, slashes,
    blanks around it, garbage) → NULL."""
    return F.to_date(F.try_to_timestamp(_col(c), F.lit(DATE_PATTERN)))


def parse_amount(c: Column | str, default: float | None = None) -> Column:
    """Text → DECIMAL(18,2); unparseable → NULL, or ``default`` when given.

    Decimal keeps sums exact and independent of partitioning; sub-cent
    digits round half-up, and 'nan'/'inf' become NULL (documented deviation
    from a float column)."""
    parsed = _col(c).try_cast(AMOUNT_TYPE)
    if default is None:
        return parsed
    return F.coalesce(parsed, F.lit(default).cast(AMOUNT_TYPE))
