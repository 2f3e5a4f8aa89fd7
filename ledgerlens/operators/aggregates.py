"""Dashboard aggregates.

Every function takes ``keys`` (e.g. ``["account_id"]``) and answers for
every key in one distributed pass; ``keys=()`` is the single-session
answer. Sums run on DECIMAL(18,2) (exact, independent of partitioning) and
are emitted as DOUBLE. Row-level data is only ever grouped (partial
aggregation before the shuffle, so a hot key costs one small buffer per
map task); windows and second-level aggregates run on the already-grouped
results, whose size is bounded by keys × categories / days / months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.formatting import weekday_name
from ledgerlens.operators.prepare import month_key
from ledgerlens.session import checkpoint_root


def _keys(keys: Sequence[str]) -> list[str]:
    return list(keys)


def money(c: Column) -> Column:
    """Exact decimal aggregate → DOUBLE for output."""
    return c.cast("double")


def _totals_window(keys: Sequence[str]) -> Window:
    # Only used over grouped results (keys × categories).
    return Window.partitionBy(*[F.col(k) for k in keys])


def category_totals(df: DataFrame, keys: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """A3 (+O2 for keys=()): total and count per category, largest first
    (``ascending=True``: smallest first, as the bar chart draws them)."""
    keys = _keys(keys)
    out = df.groupBy(*keys, "category").agg(
        money(F.sum("amount")).alias("amount"),
        F.count(F.lit(1)).alias("count"),
    )
    if keys:
        return out
    amount = F.col("amount").asc() if ascending else F.col("amount").desc()
    return out.orderBy(amount, F.col("category"))


def category_share(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A4: category totals with their percent of the key's total and a rank
    (rank 1 = the leader shown on the breakdown card)."""
    return share_of(df.groupBy(*keys, "category").agg(F.sum("amount").alias("_sum")), keys)


def share_of(grouped: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``category_share`` of the exact sums (keys, category, _sum)."""
    keys = _keys(keys)
    w = _totals_window(keys)
    rank_w = w.orderBy(F.col("_sum").desc(), F.col("category"))
    out = grouped.select(
        *keys,
        "category",
        money(F.col("_sum")).alias("amount"),
        (money(F.col("_sum")) / money(F.sum("_sum").over(w)) * 100).alias("pct"),
        F.row_number().over(rank_w).cast("bigint").alias("rank"),
    )
    return out if keys else out.orderBy("rank")


def metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A1/A2: total, count, average (0 when empty) and top category.

    Two-level aggregate: per (keys, category), then per keys; the top
    category is ``min_by(category, (-total, category))`` so a tie goes to
    the alphabetically first name. No join and no window."""
    return metrics_of(df.groupBy(*keys, "category").agg(
        F.sum("amount").alias("_sum"), F.count(F.lit(1)).alias("_n")), keys)


def metrics_of(per_cat: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``metrics`` of the exact sums and counts (keys, category, _sum, _n)."""
    keys = _keys(keys)
    out = per_cat.groupBy(*keys).agg(
        F.coalesce(F.sum("_sum"), F.lit(0)).alias("_total"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("count"),
        F.min_by("category", F.struct((-F.col("_sum")).alias("a"), F.col("category").alias("b")))
        .alias("_top"),
    )
    total = money(F.col("_total"))
    return out.select(
        *keys,
        total.alias("total"),
        F.col("count").cast("bigint").alias("count"),
        F.when(F.col("count") > 0, total / F.col("count")).otherwise(F.lit(0.0)).alias("average"),
        F.coalesce(F.col("_top"), F.lit("")).alias("top_category"),
    )


def monthly_totals(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A5: long monthly series per category with the month-start date.
    Rows with a NULL date count in totals but not here."""
    keys = _keys(keys)
    return (
        df.filter(F.col("date").isNotNull())
        .groupBy(*keys, F.trunc("date", "month").alias("month_start"), "category")
        .agg(money(F.sum("amount")).alias("amount"))
        .withColumn("month", F.date_format("month_start", "yyyy-MM"))
    )


def monthly_wide(df: DataFrame, categories: Sequence[str] | None = None,
                 keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, month), one column per category, 0-filled,
    columns alphabetical. Given ``categories`` it is a single pass. Without,
    the rows are still read once: the (keys, month, category) sums — small,
    bounded by keys × months × categories — are written to the checkpoint
    folder, the names are read from them, and the columns are conditional
    sums over that small table (a plain ``pivot`` would first scan the whole
    input for its distinct values). A NULL category becomes column "null",
    as in ``pivot``."""
    keys = _keys(keys)
    dated = df.filter(F.col("date").isNotNull()).withColumn("month", month_key("date"))
    if categories is None:
        checkpoint_root(df.sparkSession)
        sums = dated.groupBy(*keys, "month", "category").agg(F.sum("amount").alias("_s")) \
            .checkpoint(eager=True)
        # the names become the result's columns, so they belong to the plan; ``monthly_series`` is the long form
        found = [r[0] for r in sums.select("category").distinct().collect()]
        label = {("null" if v is None else v): v for v in found}
        names = sorted(label)
        if not names:   # empty input: no category columns, no rows
            return sums.select(*keys, "month")
        pivoted = sums.groupBy(*keys, "month").agg(*[
            F.sum(F.when(F.col("category").eqNullSafe(F.lit(label[c])), F.col("_s"))).alias(c)
            for c in names])
    else:
        names = sorted(categories)
        if not names:   # no columns asked for: the (keys, month) rows alone
            return dated.select(*keys, "month").distinct()
        pivoted = dated.groupBy(*keys, "month").pivot("category", names).agg(F.sum("amount"))
    return pivoted.select(
        *keys, "month",
        *[F.coalesce(money(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in names],
    )


def _weekday_wide(df: DataFrame, keys: Sequence[str], rows: str | None = None) -> DataFrame:
    """One row per key with the 7 weekday sums and counts (conditional
    aggregation: one shuffle, partial aggregation, no spine join). ``rows``
    names the number of transactions that a row stands for (one, if None)."""
    dow = F.weekday("date")
    aggs = []
    for i in range(7):
        hit = dow == i
        aggs.append(F.coalesce(F.sum(F.when(hit, F.col("amount"))), F.lit(0)).alias(f"_s{i}"))
        aggs.append((F.count(F.when(hit, F.lit(1))) if rows is None else F.coalesce(F.sum(F.when(hit, F.col(rows))), F.lit(0))).alias(f"_c{i}"))
    return df.groupBy(*keys).agg(*aggs)


def weekday_profile(df: DataFrame, keys: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Spend and count for all 7 weekdays (Mon..Sun), zero-filled.
    The calendar spine is an array of 7 structs exploded per key."""
    keys = _keys(keys)
    wide = _weekday_wide(df, keys, rows)
    spine = F.array(*[
        F.struct(F.lit(i).alias("dow"), F.col(f"_s{i}").alias("s"), F.col(f"_c{i}").alias("c"))
        for i in range(7)
    ])
    out = wide.select(*keys, F.explode(spine).alias("d")).select(
        *keys,
        F.col("d.dow").cast("bigint").alias("dow"),
        weekday_name(F.col("d.dow")).alias("day"),
        money(F.col("d.s")).alias("amount"),
        F.col("d.c").cast("bigint").alias("count"),
    )
    return out if keys else out.orderBy("dow")


def peak_weekday(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weekday with the largest spend; a tie goes to the earliest day."""
    keys = _keys(keys)
    wide = _weekday_wide(df, keys)
    ranked = F.sort_array(F.array(*[
        F.struct((-F.col(f"_s{i}")).alias("neg"), F.lit(i).alias("dow"), F.col(f"_s{i}").alias("s"))
        for i in range(7)
    ]))
    best = ranked.getItem(0)
    return wide.select(
        *keys,
        best.getField("dow").cast("bigint").alias("peak_dow"),
        weekday_name(best.getField("dow")).alias("peak_day"),
        money(best.getField("s")).alias("amount"),
    )


def daily_totals(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spend per calendar day."""
    keys = _keys(keys)
    return (
        df.filter(F.col("date").isNotNull())
        .groupBy(*keys, "date")
        .agg(money(F.sum("amount")).alias("amount"), F.count(F.lit(1)).alias("count"))
    )


def busiest_day(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The day with the largest spend; a tie goes to the earliest day.
    Second-level aggregate over the daily totals."""
    keys = _keys(keys)
    daily = (
        df.filter(F.col("date").isNotNull())
        .groupBy(*keys, "date").agg(F.sum("amount").alias("_sum"))
    )
    # Largest sum first, then earliest day, as one DECIMAL(38,0): the day
    # (shifted positive, < 2^23) sits below the negated sum in cents, so
    # ``min_by`` keeps a hash-aggregation buffer.
    rank = ((-F.col("_sum") * 100).cast("decimal(38,0)") * F.lit(2 ** 23)
            + (F.unix_date("date") + F.lit(1_000_000)))
    best = daily.groupBy(*keys).agg(
        F.min_by("date", rank).alias("date"), F.max("_sum").alias("_sum"))
    return best.select(*keys, "date", money(F.col("_sum")).alias("amount"))


def daily_average(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total ÷ days between first and last date (1 when that is 0)."""
    keys = _keys(keys)
    out = df.groupBy(*keys).agg(
        F.sum("amount").alias("_sum"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    days = F.greatest(F.coalesce(F.datediff("last_date", "first_date"), F.lit(0)), F.lit(1))
    return out.select(
        *keys, "first_date", "last_date",
        days.cast("bigint").alias("days"),
        money(F.col("_sum")).alias("total"),
        (money(F.col("_sum")) / days).alias("daily_average"),
    )


def category_total(df: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Total of one named category, shown only when non-zero."""
    keys = _keys(keys)
    out = df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("category") == name, F.col("amount"))), F.lit(0)).alias("_sum"))
    return out.filter(F.col("_sum") != 0).select(
        *keys, F.lit(name).alias("category"), money(F.col("_sum")).alias("amount"))


def category_facets(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The distinct categories with their counts over the unfiltered set."""
    keys = _keys(keys)
    out = df.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("count"))
    return out if keys else out.orderBy("category")


def filter_summary(df: DataFrame, predicate: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Filtered count, full count and filtered sum, in one pass."""
    keys = _keys(keys)
    hit = F.coalesce(predicate, F.lit(False))
    return df.groupBy(*keys).agg(
        F.count_if(hit).alias("filtered_count"),
        F.count(F.lit(1)).alias("total_count"),
        money(F.coalesce(F.sum(F.when(hit, F.col("amount"))), F.lit(0))).alias("filtered_total"),
    )


def merchant_sketches(df: DataFrame, keys: Sequence[str] = (), lg_k: int = 12) -> DataFrame:
    """A20, mergeable: per key and month (NULL: no date) a HyperLogLog sketch
    of the merchants. Sketches of months, keys or uploads can be united later
    without the rows; NULL merchants are not counted."""
    return df.groupBy(*keys, month_key("date").alias("month")).agg(F.hll_sketch_agg("merchant", F.lit(lg_k)).alias("sketch"))


def approx_merchant_count(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A20 over any set of sketches: their union's estimate. The relative
    standard error is 1.04 / sqrt(2 ** lg_k) (1.6 % for 12)."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("merchant_count"))


def merchant_count(df: DataFrame, keys: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Distinct merchants (NULL ignored); ``approx`` uses HyperLogLog++."""
    keys = _keys(keys)
    agg = F.approx_count_distinct("merchant") if approx else F.countDistinct("merchant")
    return df.groupBy(*keys).agg(agg.alias("merchant_count"))


def distinct_pairs(df: DataFrame) -> DataFrame:
    """Distinct (merchant, parsed_description) pairs to classify."""
    return df.select("merchant", "parsed_description").distinct()
