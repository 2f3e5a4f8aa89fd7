"""The dashboard bundle — five lazy results over one categorised set.

The categorised input is persisted once (memory, spilling to disk) because
five results read it; a lost executor only recomputes its partitions from
lineage. (When the categories came from an external classifier,
``categorize`` has already written them to the checkpoint folder, so a
recomputation never calls the classifier again.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ledgerlens.operators import aggregates as agg
from ledgerlens.operators import insights as ins
from ledgerlens.operators.ordering import newest_first_key
from ledgerlens.sources.sinks import to_records


def insight_cards(df: DataFrame, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The dashboard's cards in their fixed order: share, weekday, largest,
    month-over-month (keys with ≥ 2 months), recurring (keys with any)."""
    return {
        "top_category": agg.category_share(df, keys),
        "day_of_week": agg.weekday_profile(df, keys),
        "peak_day": agg.peak_weekday(df, keys),
        "largest_purchase": ins.largest_purchase(df, keys),
        "month_over_month": ins.month_over_month(df, keys),
        "recurring": ins.recurring(df, keys),
        "recurring_total": ins.recurring_total(df, keys),
    }


def alternative_cards(df: DataFrame, keys: Sequence[str] = (), named_category: str = "Travel") -> dict[str, DataFrame]:
    """The alternative UI's cards."""
    return {
        "top_category": agg.category_share(df, keys),
        "named_category": agg.category_total(df, named_category, keys),
        "recurring": ins.recurring(df, keys, min_count=2, ddof=1),
        "busiest_day": agg.busiest_day(df, keys),
        "largest_purchase": ins.largest_purchase(df, keys),
        "daily_average": agg.daily_average(df, keys),
        "month_over_month": ins.month_over_month(df, keys),
    }


def dashboard(categorised: DataFrame, keys: Sequence[str] = (),
              categories: Sequence[str] | None = None, persist: bool = True) -> dict[str, object]:
    """transactions (newest first), category_totals, monthly_series, metrics,
    insights, and release: call it when the results are no longer used, it
    gives the persisted input back."""
    df = categorised.persist(StorageLevel.MEMORY_AND_DISK) if persist else categorised
    return {
        "release": df.unpersist if persist else lambda: df,
        "transactions": to_records(df.orderBy(*newest_first_key()), include_category=True),
        "category_totals": agg.category_totals(df, keys),
        "monthly_series": agg.monthly_wide(df, categories, keys),
        "metrics": agg.metrics(df, keys),
        "insights": insight_cards(df, keys),
    }
