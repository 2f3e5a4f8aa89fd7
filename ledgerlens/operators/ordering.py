"""Orderings with explicit tie-breaks (O1, O5) and a skew-safe top-n.

pandas relied on row order for ties; here every ordering ends in
``txn_id`` so results are deterministic across partitionings.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first_key() -> list[Column]:
    """O1: newest first, bad (NULL) dates last, then txn_id."""
    return [F.col("date").desc_nulls_last(), F.col("txn_id").asc()]


# A DATE is within about ±3.7 million days of the epoch; shifting by
# _DAY_SHIFT makes every real date positive and a NULL date 0 (oldest).
_DAY_SHIFT = 1_000_000
_RANK = "decimal(38,0)"


def newest_rank(date: str = "date", txn: str = "txn_id") -> Column:
    """O1 as one number: larger = newer date, then lower txn_id; a NULL date
    is oldest. ``(shifted day) * 2^64 + (2^63 - 1 - txn_id)`` fits a
    DECIMAL(38,0), a type hash aggregation can keep in its buffer, so
    ``max`` / ``max_by`` over it stay hash aggregates (a struct key would
    force a sort of every input row before aggregating)."""
    day = F.coalesce(F.unix_date(F.col(date)), F.lit(-_DAY_SHIFT)) + F.lit(_DAY_SHIFT)
    span = F.lit(Decimal(2 ** 64)).cast(_RANK)
    return day.cast(_RANK) * span + (F.lit(Decimal(2 ** 63 - 1)).cast(_RANK) - F.col(txn).cast(_RANK))


def top_n_per_key(df: DataFrame, n: int, keys: Sequence[str], order: list[Column]) -> DataFrame:
    """First ``n`` rows per key under ``order``.

    keys=() is a global top-n: ``orderBy().limit(n)`` plans as
    TakeOrderedAndProject (per-partition top-n, then a merge of
    n × partitions rows), never a single-partition window.

    Keyed, it is ``row_number() <= n`` over ``partitionBy(keys)``; Spark's
    window-group-limit rule inserts a partial per-key top-n *before* the
    shuffle, so a hot key ships at most n rows per map task.
    """
    keys = list(keys)
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
