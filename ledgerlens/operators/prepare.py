"""Row-level preparation: the posted-purchase filter, derived columns,
merging and removing uploads, retention, preview (P1–P3, P8, P12, S6–S10)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.cleaning import clean_description
from ledgerlens.schema import PREVIEW_ROWS, STATUS_POSTED, TYPE_PURCHASE
from ledgerlens.operators.ordering import newest_first_key, top_n_per_key
from ledgerlens.operators.skew import small_enough


def posted_purchases(df: DataFrame) -> DataFrame:
    """Posted purchases with a positive amount (NULL amount drops)."""
    return df.filter(
        (F.col("status") == STATUS_POSTED)
        & (F.col("type") == TYPE_PURCHASE)
        & (F.col("amount") > 0)
    )


def positive_only(df: DataFrame) -> DataFrame:
    """The positive-amount filter applied again before reporting."""
    return df.filter(F.col("amount") > 0)


def month_key(date: Column | str = "date") -> Column:
    """P3: 'yyyy-MM' month key (NULL for a NULL date)."""
    d = F.col(date) if isinstance(date, str) else date
    return F.date_format(d, "yyyy-MM")


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", month_key("date"))


def prepare(df: DataFrame) -> DataFrame:
    """Posted purchases + month + cleaned description; status/type
    dropped. No sort: ordering is the consumer's (O1), so the prepared set
    can be written partitioned or fed to aggregates without a global sort."""
    out = (
        posted_purchases(df)
        .withColumn("month", month_key("date"))
        .withColumn("parsed_description", clean_description("merchant", "description"))
    )
    return out.drop("status", "type")


def merge_exports(*dfs: DataFrame) -> DataFrame:
    """Union all of several uploads by column name; duplicates kept."""
    if not dfs:
        raise ValueError("merge_exports needs at least one DataFrame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# Most removed-upload names turned into a broadcast anti-join.
BROADCAST_NAMES = 1_000_000


def exclude_sources(df: DataFrame, sources: Sequence[str] | DataFrame,
                    column: str = "source_file") -> DataFrame:
    """Drop the rows of removed uploads. A short list is an IN filter
    (pushed to the scan). A DataFrame of names is a left-anti join: the
    names are counted first and broadcast when there are at most
    ``BROADCAST_NAMES`` (no shuffle of the rows, so one big upload cannot
    overload a task); beyond that a sort-merge anti-join, where AQE splits
    a skewed source partition."""
    if isinstance(sources, DataFrame):
        names = sources.select(F.col(column)).distinct()
        if small_enough(names, BROADCAST_NAMES):
            names = F.broadcast(names)
        return df.join(names, column, "left_anti")
    if not sources:
        return df
    return df.filter(~F.col(column).isin(list(sources)))


def retain_recent(df: DataFrame, ts: str, now: str | Column, ttl: str = "2 hours") -> DataFrame:
    """Keep rows stamped at or after ``now - ttl`` (the stamp is the
    creation time; it is never renewed). ``now`` is passed in so a run is
    repeatable."""
    now_col = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return df.filter(F.col(ts) >= now_col - F.expr(f"INTERVAL {ttl}"))


def require_nonempty(df: DataFrame) -> DataFrame:
    """Refuse a prepared load without rows."""
    if df.isEmpty():
        raise ValueError("the load holds no row that is posted, a purchase and above zero")
    return df


def empty_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """S10, keyed: the keys whose load holds no posted purchase."""
    return (
        df.groupBy(*keys)
        .agg(F.count_if((F.col("status") == STATUS_POSTED) & (F.col("type") == TYPE_PURCHASE)
                        & (F.col("amount") > 0)).alias("posted_count"))
        .filter(F.col("posted_count") == 0)
    )


def preview_rows(df: DataFrame, n: int = PREVIEW_ROWS, keys: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows per key (whole rows, newest first)."""
    return top_n_per_key(df, n, keys, newest_first_key())


def preview(df: DataFrame, n: int = PREVIEW_ROWS, keys: Sequence[str] = ()) -> DataFrame:
    """Per key the row count, distinct merchants, rows not shown and
    whether any shown row's description differs from its merchant.

    The two halves (counts over all rows, flag over the shown rows) are
    merged by union + re-aggregation on the keys, so no join is needed."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.countDistinct("merchant").alias("merchant_count"),
        F.lit(None).cast("boolean").alias("shows_description"),
    )
    shown = preview_rows(df, n, keys).groupBy(*keys).agg(
        F.lit(None).cast("bigint").alias("transaction_count"),
        F.lit(None).cast("bigint").alias("merchant_count"),
        F.bool_or(F.col("description") != F.col("merchant")).alias("shows_description"),
    )
    merged = counts.unionByName(shown).groupBy(*keys).agg(
        F.coalesce(F.max("transaction_count"), F.lit(0)).alias("transaction_count"),
        F.coalesce(F.max("merchant_count"), F.lit(0)).alias("merchant_count"),
        F.coalesce(F.max("shows_description"), F.lit(False)).alias("shows_description"),
    )
    return merged.withColumn(
        "hidden_rows", F.greatest(F.col("transaction_count") - F.lit(n), F.lit(0)))
