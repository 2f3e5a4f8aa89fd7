"""Insight cards.

Skew: a key (an account, a blank merchant) may hold a third of all rows.
Nothing here windows or collects row-level data per key: per-merchant
statistics come from a two-level aggregate over distinct amounts, the
largest purchase is ``max_by`` (partial aggregation), and the only windows
run over monthly aggregates (months per key, a small bounded count).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.formatting import long_date, month_label
from ledgerlens.operators.aggregates import money
from ledgerlens.operators.ordering import newest_rank
from ledgerlens.operators.skew import BROADCAST_ROWS, HOT_ROWS, balanced_join
from ledgerlens.operators.prepare import month_key
from ledgerlens.session import checkpoint_root

# The recurring-charge rule of the reference.
RECURRING_STD_RATIO = 0.25
RECURRING_MAX_DISTINCT = 2


def merchant_stats(df: DataFrame, keys: Sequence[str] = (), by: str = "merchant") -> DataFrame:
    """A9 (+W3): per (keys, merchant) count, mean, population and sample
    standard deviation, distinct amounts, total (and its exact decimal) and
    the latest charge.

    Level 1 groups (keys, merchant, amount): partial aggregation shrinks
    each map task to its distinct amounts, so a hot merchant cannot flood
    one reducer. Level 2 folds those rows into exact decimal sums and
    sums of squares; the deviations are computed once from them, in one
    fixed IEEE expression, so every engine and partitioning agrees. The
    latest charge is ``max_by`` over a numeric newest-first rank, so both
    levels are hash aggregates.
    """
    keys = list(keys)
    lvl1 = df.groupBy(*keys, by, "amount").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(newest_rank()).alias("_newest"),
    )
    return stats_of(lvl1, keys, by)


def stats_of(lvl1: DataFrame, keys: Sequence[str] = (), by: str = "merchant") -> DataFrame:
    """``merchant_stats`` of the amounts of each merchant (keys, merchant,
    amount, _n, _newest): level 2."""
    keys = list(keys)
    lvl2 = lvl1.groupBy(*keys, by).agg(
        F.sum("_n").alias("count"),
        F.sum(F.when(F.col("amount").isNotNull(), F.col("_n"))).alias("_known"),
        F.count("amount").alias("distinct_amounts"),
        F.sum(F.col("amount") * F.col("_n")).alias("_sum"),
        F.sum(F.col("amount") * F.col("amount") * F.col("_n")).alias("_sumsq"),
        F.max_by("amount", "_newest").alias("_latest"),
    )
    n = F.col("_known").cast("double")   # rows without an amount say nothing about it
    s = money(F.col("_sum"))
    ss = money(F.col("_sumsq"))
    dev = ss - s * s / n
    return lvl2.select(
        *keys,
        F.col(by).alias("name"),
        F.col("count").cast("bigint").alias("count"),
        (s / n).alias("avg"),
        F.sqrt(F.greatest(dev / n, F.lit(0.0))).alias("std_pop"),
        F.when(n > 1, F.sqrt(F.greatest(dev / (n - 1), F.lit(0.0)))).alias("std_samp"),
        F.col("distinct_amounts").cast("bigint").alias("distinct_amounts"),
        s.alias("total"),
        money(F.col("_latest")).alias("latest_amount"),
        F.col("_sum").alias("total_exact"),
    )


def recurring(df: DataFrame, keys: Sequence[str] = (), min_count: int = 3, ddof: int = 0,
              by: str = "merchant", exact: bool = False) -> DataFrame:
    """Merchants charged at least ``min_count`` times whose
    amounts are steady (std < 0.25 × mean) or take at most two values.

    ``ddof=0`` (population std, ≥3 charges) is the dashboard card, sorted
    by total; ``ddof=1`` with ``min_count=2`` is the alternative card,
    sorted by name ignoring case, which also shows the latest charge."""
    return recurring_of(merchant_stats(df, keys, by), keys, min_count, ddof, exact)


def recurring_of(stats: DataFrame, keys: Sequence[str] = (), min_count: int = 3, ddof: int = 0, exact: bool = False) -> DataFrame:
    """``recurring`` of merchants' statistics."""
    keys = list(keys)
    std = F.col("std_pop") if ddof == 0 else F.col("std_samp")
    steady = F.coalesce(std < F.col("avg") * RECURRING_STD_RATIO, F.lit(False))
    out = stats.filter(
        (F.col("count") >= min_count)
        & (steady | (F.col("distinct_amounts") <= RECURRING_MAX_DISTINCT))
    )
    cols = [*keys, "name", "count", "avg", "total"]
    if ddof != 0:
        cols.append("latest_amount")
    if exact:
        cols.append("total_exact")
    out = out.select(*cols)
    if keys:
        return out
    if ddof == 0:
        return out.orderBy(F.col("total").desc(), F.col("name"))
    return out.orderBy(F.lower("name"), F.col("name"))


def recurring_total(df: DataFrame, keys: Sequence[str] = (), min_count: int = 3,
                    ddof: int = 0) -> DataFrame:
    """Grand total and number of recurring merchants per key."""
    return recurring_total_of(recurring(df, keys, min_count, ddof, exact=True), keys)


def recurring_total_of(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``recurring_total`` of recurring merchants with their exact totals."""
    keys = list(keys)
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("recurring_count"),
        money(F.sum("total_exact")).alias("grand_total"),
    )


def frequent_merchant_rows(df: DataFrame, min_count: int = 2, keys: Sequence[str] = (),
                           by: str = "merchant", hot_rows: int = HOT_ROWS,
                           broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of merchants charged at least ``min_count`` times.

    The per-merchant counts (one partial aggregation) are written once to
    the checkpoint folder; the rows are then left-semi joined with the
    qualifying merchants: broadcast when there are at most
    ``broadcast_rows`` of them, else a sort-merge join with each merchant of
    more than ``hot_rows`` rows salted over several tasks
    (``skew.balanced_join``)."""
    keys = list(keys)
    on = [*keys, by]
    checkpoint_root(df.sparkSession)
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("count")).checkpoint(eager=True)
    frequent = counts.filter(F.col("count") >= min_count).select(*on)
    salt_by = ["txn_id"] if "txn_id" in df.columns else df.columns
    return balanced_join(df, frequent, on, "left_semi", counts, salt_by, hot_rows, broadcast_rows)


def monthly_series(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Monthly totals per key over the months present (NULL dates left out)."""
    keys = list(keys)
    return (
        df.filter(F.col("date").isNotNull())
        .groupBy(*keys, month_key("date").alias("month"))
        .agg(F.sum("amount").alias("_sum"))
    )


def month_over_month(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The last month present against the month present before it
    (gaps are skipped), signed percent change, 'up' when > 0 else 'down'.
    Keys with fewer than two months give no row.

    ``lag`` and ``row_number`` run on the monthly aggregate, partitioned by
    key: at most one row per month present, whatever the row volume."""
    return change_of(monthly_series(df, keys), keys)


def change_of(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``month_over_month`` of the exact monthly sums (keys, month, _sum)."""
    keys = list(keys)
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("month")
    last_w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(F.col("month").desc())
    with_prev = monthly.select(
        *keys, "month", "_sum",
        F.lag("month").over(w).alias("_prev_month"),
        F.lag("_sum").over(w).alias("_prev_sum"),
        F.row_number().over(last_w).alias("_rn"),
    ).filter((F.col("_rn") == 1) & F.col("_prev_month").isNotNull())
    curr = money(F.col("_sum"))
    prev = money(F.col("_prev_sum"))
    pct = F.try_divide(curr - prev, prev) * 100
    direction = F.when(pct > 0, F.lit("up")).otherwise(F.lit("down"))
    return with_prev.select(
        *keys,
        F.col("month").alias("curr_month"),
        month_label(F.col("month")).alias("curr_label"),
        curr.alias("curr_amount"),
        F.col("_prev_month").alias("prev_month"),
        month_label(F.col("_prev_month")).alias("prev_label"),
        prev.alias("prev_amount"),
        F.abs(pct).alias("pct"),
        direction.alias("direction"),
        F.concat(F.lit("mom_"), direction).alias("card_type"),
    )


def largest_purchase(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The whole row of the largest amount per key; a tie goes to the
    first row in newest-first order (later date, then lower txn_id).

    Without keys it is a top-1 (``orderBy().limit(1)`` → TakeOrderedAndProject):
    each task keeps one row in a bounded heap, no sort of the input. Keyed,
    ``max_by`` aggregates partially on every map task (skew-safe); its
    struct value keeps it a sort-based aggregate, which sorts each task's
    rows locally but ships one row per key per task — cheaper at scale than
    a second scan to fetch the winning rows."""
    keys = list(keys)
    fields = [c for c in ["txn_id", "date", "merchant", "description", "amount", "category"]
              if c in df.columns]
    if not keys:
        top = df.orderBy(F.col("amount").desc_nulls_last(), F.col("date").desc_nulls_last(),
                         F.col("txn_id").asc_nulls_last()).limit(1)
        best = top.select(F.struct(*fields).alias("_row"))
    else:
        order = F.struct(F.col("amount"), F.col("date"), (-F.col("txn_id")).alias("neg_txn"))
        best = df.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_row"))
    return best.filter(F.col("_row").isNotNull()).select(
        *keys,
        *[F.col(f"_row.{c}").alias(c) for c in fields if c != "amount"],
        money(F.col("_row.amount")).alias("amount"),
        long_date(F.col("_row.date")).alias("date_label"),
    )

