"""Named queries over the driver's tables and their DuckDB oracles.

Each entry of ``QUERIES`` takes ``(spark, sf_dir)`` and returns a DataFrame
built from ledgerlens operators over whole tables. Most are lazy; those that
classify pairs, use the cache, page by key, write exports or run a stream do
jobs while they are built. ``ORACLES`` holds SQL for the same answer; the
cleaning and rule oracles share the fixed patterns, the recurring-charge ones
the formula of the deviation (unit tests check both otherwise). Names and types match: sums as
DOUBLE from exact decimals, counts as BIGINT, days as DATE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import cleaning as cl
from ledgerlens.functions import formatting as fmt
from ledgerlens.operators import aggregates as agg
from ledgerlens.operators import classify as cls
from ledgerlens.operators import explore as ex
from ledgerlens.operators import indexes
from ledgerlens.operators import insights as ins
from ledgerlens.operators import prepare as prep
from ledgerlens.plans.report import dashboard
from ledgerlens.plans.rollups import DashboardStore
from ledgerlens.schema import CATEGORIES, REPLY_SCHEMA
from ledgerlens.session import scratch_path
from ledgerlens.sources import cache, exports, sinks
from ledgerlens.sources.feeds import (
    FEED_E_SQL, FEED_L_SQL, FEED_O_SQL, feed_events, feed_lineitem, feed_orders,
)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


POSTED = "status = 'Posted' AND type = 'Purchase' AND amount > 0"


def _with(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in parts) + "\n"


L_POSTED = (("feed_l", FEED_L_SQL), ("p", f"SELECT * FROM feed_l WHERE {POSTED}"))
O_ALL = (("feed_o", FEED_O_SQL),)
O_POSTED = (("feed_o", FEED_O_SQL), ("p", f"SELECT * FROM feed_o WHERE {POSTED}"))
E_ALL = (("feed_e", FEED_E_SQL),)

ACCT = ["account_id"]


def l_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.posted_purchases(feed_lineitem(spark, sf_dir))


def o_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.posted_purchases(feed_orders(spark, sf_dir))


def d(col: str) -> str:
    """Oracle: exact decimal → DOUBLE."""
    return f"CAST({col} AS DOUBLE)"


# ---------------------------------------------------------------------------
# Oracle text for the cleaning expressions (RE2 flavour, same patterns).
# ---------------------------------------------------------------------------

def clean_sql(m: str, desc: str) -> str:
    src = f"(CASE WHEN {desc} <> '' THEN {desc} ELSE {m} END)"
    s1 = f"regexp_replace({src}, '{cl.PREFIX_RE2}', '', 'i')"
    s2 = f"regexp_replace(regexp_replace({s1}, '{cl.LOCATION_RE2}', ''), '{cl.LOCATION_RE2}', '')"
    s3 = f"regexp_replace({s2}, '{cl.DOMAIN_RE2}', '', 'gi')"
    s4 = f"regexp_replace({s3}, '{cl.TRAILING_CODE_RE2}', '')"
    s5 = f"trim(regexp_replace({s4}, '\\s+', ' ', 'g'), '{cl.EDGE_CHARS}')"
    return (f"(CASE WHEN {src} = '' THEN {m} "
            f"WHEN length({s5}) < 2 OR regexp_matches({s5}, '{cl.CODE_ONLY_RE2}') THEN {m} "
            f"ELSE {s5} END)")


def display_sql(desc: str) -> str:
    stripped = f"trim(regexp_replace({desc}, '{cl.PREFIX_RE2}', '', 'i'), '{cl.EDGE_CHARS}')"
    return f"(CASE WHEN length({stripped}) < 3 THEN {desc} ELSE {stripped} END)"


def rule_sql(m: str, pd_: str) -> str:
    return cls.rule_category_sql(f"lower({m} || ' ' || {pd_})")


def month_label_sql(m: str) -> str:
    return f"strftime(strptime({m} || '-01', '%Y-%m-%d'), '%b %Y')"


O_PREPARED = (*O_POSTED, ("q", f"SELECT *, strftime(date, '%Y-%m') AS month, "
                               f"{clean_sql('merchant', 'description')} AS parsed_description FROM p"))


def o_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.prepare(feed_orders(spark, sf_dir))


# ---------------------------------------------------------------------------
# Sources and preparation
# ---------------------------------------------------------------------------

def orders_as_dialect_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEED_O rendered as dialect-A export text (Time/Cardholder absent)."""
    o = feed_orders(spark, sf_dir)
    return o.select(
        "account_id", "txn_id", "source_file", "dialect",
        F.date_format("date", "yyyy-M-d").alias("Date"),
        F.col("amount").cast("string").alias("Amount"),
        F.col("merchant").alias("Merchant"),
        F.col("description").alias("Description"),
        F.col("status").alias("Status"),
        F.col("type").alias("Type"),
    )


def orders_as_dialect_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEED_O rendered as dialect-B export text: a pending order has a blank
    debit, a '5-LOW' order is marked as a payment/credit."""
    o = feed_orders(spark, sf_dir)
    return o.select(
        "account_id", "txn_id", "source_file", F.lit("B").alias("dialect"),
        F.date_format("date", "yyyy-MM-dd").alias("Transaction Date"),
        F.date_format("date", "yyyy-MM-dd").alias("Posted Date"),
        F.when(F.col("status") == "Pending", F.lit("")).otherwise(F.col("amount").cast("string")).alias("Debit"),
        F.col("description").alias("Description"),
        F.when(F.col("merchant") == "5-LOW", F.lit("Payment/Credit")).otherwise(F.col("category")).alias("Category"),
    )


PREPARED_OUT = ["account_id", "txn_id", "date", "time", "amount", "merchant", "description",
                "month", "parsed_description"]


@register("prepare_purchases", _with(*O_PREPARED) + """
SELECT account_id, txn_id, date, time, CAST(amount AS DOUBLE) AS amount, merchant, description,
       month, parsed_description FROM q""")
def q_prepare_purchases(spark, sf_dir):
    out = prep.prepare(exports.normalize_a(orders_as_dialect_a(spark, sf_dir)))
    return out.withColumn("amount", F.col("amount").cast("double")).select(*PREPARED_OUT)


@register("normalize_debit", _with(*O_ALL) + f"""
SELECT txn_id, date,
       CASE WHEN status = 'Pending' THEN 0.0 ELSE CAST(amount AS DOUBLE) END AS amount,
       {display_sql('description')} AS merchant, description, 'Posted' AS status,
       CASE WHEN status = 'Pending' OR amount = 0 OR merchant = '5-LOW' THEN 'Payment' ELSE 'Purchase' END AS type
FROM feed_o""")
def q_normalize_debit(spark, sf_dir):
    out = exports.normalize_b(orders_as_dialect_b(spark, sf_dir))
    return out.select("txn_id", "date", F.col("amount").cast("double").alias("amount"),
                      "merchant", "description", "status", "type")


@register("clean_description", _with(*O_ALL) + f"""
SELECT txn_id, merchant, description, {clean_sql('merchant', 'description')} AS parsed_description
FROM feed_o""")
def q_clean_description(spark, sf_dir):
    o = feed_orders(spark, sf_dir)
    return o.select("txn_id", "merchant", "description",
                    cl.clean_description("merchant", "description").alias("parsed_description"))


@register("display_merchant", _with(*O_ALL) + f"""
SELECT txn_id, description, {display_sql('description')} AS display_merchant FROM feed_o""")
def q_display_merchant(spark, sf_dir):
    o = feed_orders(spark, sf_dir)
    return o.select("txn_id", "description", cl.display_merchant("description").alias("display_merchant"))


@register("merge_exports", _with(*O_ALL) + """
SELECT source_file, account_id, txn_id, date, CAST(amount AS DOUBLE) AS amount, merchant FROM feed_o
WHERE source_file IN ('export_1.csv', 'export_2.csv', 'export_3.csv')
UNION ALL
SELECT source_file, account_id, txn_id, date, CAST(amount AS DOUBLE) AS amount, merchant FROM feed_o
WHERE source_file IN ('export_3.csv', 'export_4.csv', 'export_5.csv')""")
def q_merge_exports(spark, sf_dir):
    """Two uploads that overlap on one source: the overlap is kept twice."""
    o = feed_orders(spark, sf_dir).select(
        "source_file", "account_id", "txn_id", "date", F.col("amount").cast("double").alias("amount"),
        "merchant")
    first = o.filter(F.col("source_file").isin("export_1.csv", "export_2.csv", "export_3.csv"))
    second = o.filter(F.col("source_file").isin("export_3.csv", "export_4.csv", "export_5.csv"))
    return prep.merge_exports(first, second)


@register("exclude_sources", _with(*O_ALL) + """
SELECT source_file, txn_id, CAST(amount AS DOUBLE) AS amount FROM feed_o
WHERE source_file NOT IN ('export_5.csv')""")
def q_exclude_sources(spark, sf_dir):
    o = feed_orders(spark, sf_dir)
    return prep.exclude_sources(o, ["export_5.csv"]).select(
        "source_file", "txn_id", F.col("amount").cast("double").alias("amount"))


@register("exclude_sources_table", _with(*O_ALL) + """
SELECT source_file, txn_id, CAST(amount AS DOUBLE) AS amount FROM feed_o
WHERE source_file NOT IN (SELECT source_file FROM feed_o WHERE merchant IN ('5-LOW', '1-URGENT'))""")
def q_exclude_sources_table(spark, sf_dir):
    """S7 with a table of names."""
    o = feed_orders(spark, sf_dir)
    gone = o.filter(F.col("merchant").isin("5-LOW", "1-URGENT")).select("source_file")
    return prep.exclude_sources(o, gone).select("source_file", "txn_id", F.col("amount").cast("double").alias("amount"))


@register("positive_only", _with(*O_ALL) + """
SELECT txn_id, date, CAST(amount AS DOUBLE) AS amount FROM feed_o WHERE status <> 'Pending' AND amount > 0""")
def q_positive_only(spark, sf_dir):
    """P8 on dialect-B rows, where a blank debit reads as amount 0."""
    out = prep.positive_only(exports.normalize_b(orders_as_dialect_b(spark, sf_dir)))
    return out.select("txn_id", "date", F.col("amount").cast("double").alias("amount"))


@register("preview_top12",_with(*O_PREPARED) + """
SELECT txn_id, date, merchant, description, CAST(amount AS DOUBLE) AS amount FROM q
ORDER BY date DESC NULLS LAST, txn_id LIMIT 12""")
def q_preview_top12(spark, sf_dir):
    rows = prep.preview_rows(o_prepared(spark, sf_dir), 12)
    return rows.select("txn_id", "date", "merchant", "description",
                       F.col("amount").cast("double").alias("amount"))


@register("preview_by_account", _with(*O_PREPARED, ("r", """
SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY date DESC NULLS LAST, txn_id) AS rn FROM q"""),
    ("c", "SELECT account_id, COUNT(*) AS n, COUNT(DISTINCT merchant) AS mc FROM q GROUP BY account_id"),
    ("f", "SELECT account_id, bool_or(description <> merchant) AS flag FROM r WHERE rn <= 12 GROUP BY account_id")) + """
SELECT c.account_id, c.n AS transaction_count, c.mc AS merchant_count,
       COALESCE(f.flag, false) AS shows_description, greatest(c.n - 12, 0) AS hidden_rows
FROM c LEFT JOIN f ON c.account_id = f.account_id""")
def q_preview_by_account(spark, sf_dir):
    return prep.preview(o_prepared(spark, sf_dir), 12, ACCT)


@register("retain_recent", _with(*E_ALL) + """
SELECT account_id, txn_id, ts, CAST(amount AS DOUBLE) AS amount FROM feed_e
WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' - INTERVAL 2 HOUR""")
def q_retain_recent(spark, sf_dir):
    e = feed_events(spark, sf_dir)
    return prep.retain_recent(e, "ts", "2024-01-16 00:00:00", "2 hours").select(
        "account_id", "txn_id", "ts", F.col("amount").cast("double").alias("amount"))


@register("empty_accounts", _with(*O_ALL) + f"""
SELECT account_id, COUNT(*) FILTER (WHERE {POSTED}) AS posted_count FROM feed_o
GROUP BY account_id HAVING COUNT(*) FILTER (WHERE {POSTED}) = 0""")
def q_empty_accounts(spark, sf_dir):
    """S10, keyed: the accounts whose load holds no posted purchase (each
    would be refused on its own)."""
    return prep.empty_keys(feed_orders(spark, sf_dir), ACCT)


# ---------------------------------------------------------------------------
# Aggregates
# ---------------------------------------------------------------------------

@register("category_share", _with(*L_POSTED, ("g", "SELECT category, SUM(amount) AS s FROM p GROUP BY category")) + """
SELECT category, CAST(s AS DOUBLE) AS amount,
       CAST(s AS DOUBLE) / CAST(SUM(s) OVER () AS DOUBLE) * 100 AS pct,
       ROW_NUMBER() OVER (ORDER BY s DESC, category) AS rank
FROM g""")
def q_category_share(spark, sf_dir):
    return agg.category_share(l_posted(spark, sf_dir))


@register("category_totals", _with(*L_POSTED) + """
SELECT category, CAST(SUM(amount) AS DOUBLE) AS amount, COUNT(*) AS count FROM p GROUP BY category""")
def q_category_totals(spark, sf_dir):
    return agg.category_totals(l_posted(spark, sf_dir))


METRICS_SQL = """
SELECT {keys_sel} CAST(COALESCE(SUM(s), 0) AS DOUBLE) AS total, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS count,
       CASE WHEN COALESCE(SUM(n), 0) > 0 THEN CAST(COALESCE(SUM(s), 0) AS DOUBLE) / CAST(SUM(n) AS BIGINT) ELSE 0.0 END AS average,
       COALESCE(arg_min(category, (-s, category)), '') AS top_category
FROM (SELECT {keys_sel} category, SUM(amount) AS s, COUNT(*) AS n FROM p GROUP BY ALL) t {group}"""


@register("metrics", _with(*L_POSTED) + METRICS_SQL.format(keys_sel="", group=""))
def q_metrics(spark, sf_dir):
    return agg.metrics(l_posted(spark, sf_dir))


@register("metrics_by_account", _with(*O_POSTED) + METRICS_SQL.format(keys_sel="account_id,", group="GROUP BY account_id"))
def q_metrics_by_account(spark, sf_dir):
    return agg.metrics(o_posted(spark, sf_dir), ACCT)


@register("monthly_totals", _with(*L_POSTED) + """
SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, category,
       CAST(SUM(amount) AS DOUBLE) AS amount, strftime(date_trunc('month', date), '%Y-%m') AS month
FROM p WHERE date IS NOT NULL GROUP BY ALL""")
def q_monthly_totals(spark, sf_dir):
    return agg.monthly_totals(l_posted(spark, sf_dir))


P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register("monthly_wide", _with(*L_POSTED) + "SELECT strftime(date, '%Y-%m') AS month, " + ", ".join(
    f"CAST(COALESCE(SUM(amount) FILTER (WHERE category = '{c}'), 0) AS DOUBLE) AS \"{c}\"" for c in P_TYPES)
    + " FROM p WHERE date IS NOT NULL GROUP BY 1")
def q_monthly_wide(spark, sf_dir):
    # Category columns discovered from the (month, category) sums after one read of the rows.
    return agg.monthly_wide(l_posted(spark, sf_dir))


WEEKDAY_SQL = """
, spine AS (SELECT {keys_sel} unnest(range(7)) AS dow FROM {keysrc})
, g AS (SELECT {keys_sel} isodow(date) - 1 AS dow, SUM(amount) AS s, COUNT(*) AS n FROM p WHERE date IS NOT NULL GROUP BY ALL)
SELECT {spine_keys} spine.dow AS dow, list_extract(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'], spine.dow + 1) AS day,
       CAST(COALESCE(g.s, 0) AS DOUBLE) AS amount, COALESCE(g.n, 0) AS count
FROM spine LEFT JOIN g ON spine.dow = g.dow {join_keys}"""


@register("weekday_profile", _with(*L_POSTED)[:-1] + WEEKDAY_SQL.format(
    keys_sel="", keysrc="(SELECT 1)", spine_keys="", join_keys=""))
def q_weekday_profile(spark, sf_dir):
    return agg.weekday_profile(l_posted(spark, sf_dir))


@register("weekday_profile_by_account", _with(*O_POSTED)[:-1] + WEEKDAY_SQL.format(
    keys_sel="account_id,", keysrc="(SELECT DISTINCT account_id FROM p)", spine_keys="spine.account_id,",
    join_keys="AND spine.account_id = g.account_id"))
def q_weekday_profile_by_account(spark, sf_dir):
    return agg.weekday_profile(o_posted(spark, sf_dir), ACCT)


PEAK_SQL = """
, spine AS (SELECT {keys_sel} unnest(range(7)) AS dow FROM {keysrc})
, g AS (SELECT {keys_sel} isodow(date) - 1 AS dow, SUM(amount) AS s FROM p WHERE date IS NOT NULL GROUP BY ALL)
, z AS (SELECT {spine_keys} spine.dow, COALESCE(g.s, 0) AS s FROM spine LEFT JOIN g ON spine.dow = g.dow {join_keys})
, r AS (SELECT *, ROW_NUMBER() OVER ({part} ORDER BY s DESC, dow) AS rn FROM z)
SELECT {out_keys} dow AS peak_dow, list_extract(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'], dow + 1) AS peak_day,
       CAST(s AS DOUBLE) AS amount FROM r WHERE rn = 1"""


@register("peak_weekday", _with(*L_POSTED)[:-1] + PEAK_SQL.format(
    keys_sel="", keysrc="(SELECT 1)", spine_keys="", join_keys="", part="", out_keys=""))
def q_peak_weekday(spark, sf_dir):
    return agg.peak_weekday(l_posted(spark, sf_dir))


@register("peak_weekday_by_account", _with(*O_POSTED)[:-1] + PEAK_SQL.format(
    keys_sel="account_id,", keysrc="(SELECT DISTINCT account_id FROM p)", spine_keys="spine.account_id,",
    join_keys="AND spine.account_id = g.account_id", part="PARTITION BY account_id", out_keys="account_id,"))
def q_peak_weekday_by_account(spark, sf_dir):
    return agg.peak_weekday(o_posted(spark, sf_dir), ACCT)


@register("daily_totals", _with(*O_POSTED) + """
SELECT account_id, date, CAST(SUM(amount) AS DOUBLE) AS amount, COUNT(*) AS count
FROM p WHERE date IS NOT NULL GROUP BY ALL""")
def q_daily_totals(spark, sf_dir):
    return agg.daily_totals(o_posted(spark, sf_dir), ACCT)


@register("busiest_day", _with(*L_POSTED) + """
SELECT date, CAST(s AS DOUBLE) AS amount FROM (
  SELECT date, SUM(amount) AS s FROM p WHERE date IS NOT NULL GROUP BY date) t
ORDER BY s DESC, date LIMIT 1""")
def q_busiest_day(spark, sf_dir):
    return agg.busiest_day(l_posted(spark, sf_dir))


@register("busiest_day_by_account", _with(*O_POSTED) + """
SELECT account_id, date, CAST(s AS DOUBLE) AS amount FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY s DESC, date) AS rn FROM (
    SELECT account_id, date, SUM(amount) AS s FROM p WHERE date IS NOT NULL GROUP BY ALL) t) u
WHERE rn = 1""")
def q_busiest_day_by_account(spark, sf_dir):
    return agg.busiest_day(o_posted(spark, sf_dir), ACCT)


@register("daily_average", _with(*O_POSTED) + """
SELECT account_id, MIN(date) AS first_date, MAX(date) AS last_date,
       greatest(COALESCE(date_diff('day', MIN(date), MAX(date)), 0), 1) AS days,
       CAST(SUM(amount) AS DOUBLE) AS total,
       CAST(SUM(amount) AS DOUBLE) / greatest(COALESCE(date_diff('day', MIN(date), MAX(date)), 0), 1) AS daily_average
FROM p GROUP BY account_id""")
def q_daily_average(spark, sf_dir):
    return agg.daily_average(o_posted(spark, sf_dir), ACCT)


@register("category_total_named", _with(*L_POSTED) + """
SELECT 'PROMO' AS category, CAST(s AS DOUBLE) AS amount FROM (
  SELECT COALESCE(SUM(amount) FILTER (WHERE category = 'PROMO'), 0) AS s FROM p) t WHERE s <> 0""")
def q_category_total_named(spark, sf_dir):
    return agg.category_total(l_posted(spark, sf_dir), "PROMO")


@register("category_facets", _with(*L_POSTED) + "SELECT category, COUNT(*) AS count FROM p GROUP BY category")
def q_category_facets(spark, sf_dir):
    return agg.category_facets(l_posted(spark, sf_dir))


@register("merchant_count", _with(*L_POSTED) + "SELECT COUNT(DISTINCT merchant) AS merchant_count FROM p")
def q_merchant_count(spark, sf_dir):
    return agg.merchant_count(l_posted(spark, sf_dir))


@register("merchant_count_by_account", _with(*O_POSTED) + """
SELECT account_id, COUNT(DISTINCT merchant) AS merchant_count FROM p GROUP BY account_id""")
def q_merchant_count_by_account(spark, sf_dir):
    return agg.merchant_count(o_posted(spark, sf_dir), ACCT)


L_PREPARED = (*L_POSTED, ("q", f"SELECT *, {clean_sql('merchant', 'description')} AS parsed_description FROM p"))


@register("distinct_pairs", _with(*L_PREPARED) + "SELECT DISTINCT merchant, parsed_description FROM q")
def q_distinct_pairs(spark, sf_dir):
    return agg.distinct_pairs(prep.prepare(feed_lineitem(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Insights (A9–A13, W1–W3, J4)
# ---------------------------------------------------------------------------

def stats_sql(keys: str, by: str, source: str, amount: str = "amount") -> str:
    n = "CAST(COUNT(*) AS DOUBLE)"
    s = f"CAST(SUM({amount}) AS DOUBLE)"
    ss = f"CAST(SUM(CAST({amount} AS DECIMAL(38,2)) * {amount}) AS DOUBLE)"
    dev = f"({ss} - {s} * {s} / {n})"
    return f"""
SELECT {keys}, {by} AS name, COUNT(*) AS count, {s} / {n} AS avg,
       sqrt(greatest({dev} / {n}, 0.0)) AS std_pop,
       CASE WHEN COUNT(*) > 1 THEN sqrt(greatest({dev} / ({n} - 1), 0.0)) END AS std_samp,
       COUNT(DISTINCT {amount}) AS distinct_amounts, {s} AS total, SUM({amount}) AS total_exact,
       CAST(arg_max({amount}, (date, -txn_id)) AS DOUBLE) AS latest_amount
FROM {source} GROUP BY {keys}, {by}"""


@register("merchant_stats", _with(*O_ALL, ("st", stats_sql("account_id", "merchant", "feed_o"))) + """
SELECT account_id, name, count, avg, std_pop, std_samp, distinct_amounts, total, latest_amount FROM st""")
def q_merchant_stats(spark, sf_dir):
    return ins.merchant_stats(feed_orders(spark, sf_dir), ACCT).drop("total_exact")


def recurring_sql(keys: str, min_count: int, std: str, extra: str = "") -> str:
    return f"""
SELECT {keys}, name, count, avg, total{extra} FROM st
WHERE count >= {min_count} AND (COALESCE({std} < avg * 0.25, false) OR distinct_amounts <= 2)"""


@register("recurring_by_account", _with(*O_ALL, ("st", stats_sql("account_id", "merchant", "feed_o")))
          + recurring_sql("account_id", 3, "std_pop"))
def q_recurring_by_account(spark, sf_dir):
    return ins.recurring(feed_orders(spark, sf_dir), ACCT)


@register("recurring_loose", _with(*O_ALL, ("st", stats_sql("account_id", "merchant", "feed_o")))
          + recurring_sql("account_id", 2, "std_samp", ", latest_amount"))
def q_recurring_loose(spark, sf_dir):
    return ins.recurring(feed_orders(spark, sf_dir), ACCT, min_count=2, ddof=1)


BUCKET = "CAST(floor(amount / 250000) * 250000 AS DECIMAL(18,2))"


@register("recurring_bucketed", _with(*O_ALL, ("b", f"SELECT account_id, merchant, txn_id, date, {BUCKET} AS amount FROM feed_o"),
                                      ("st", stats_sql("account_id", "merchant", "b")))
          + recurring_sql("account_id", 3, "std_pop"))
def q_recurring_bucketed(spark, sf_dir):
    o = feed_orders(spark, sf_dir).withColumn(
        "amount", (F.floor(F.col("amount") / 250000) * 250000).cast("decimal(18,2)"))
    return ins.recurring(o, ACCT)


@register("recurring_total", _with(*O_ALL, ("st", stats_sql("account_id", "merchant", "feed_o")),
                                   ("r", recurring_sql("account_id", 3, "std_pop", ", total_exact"))) + """
SELECT account_id, COUNT(*) AS recurring_count, CAST(SUM(total_exact) AS DOUBLE) AS grand_total FROM r GROUP BY account_id""")
def q_recurring_total(spark, sf_dir):
    return ins.recurring_total(feed_orders(spark, sf_dir), ACCT)


@register("frequent_merchant_rows", _with(*O_POSTED) + """
SELECT txn_id, account_id, merchant FROM p
WHERE EXISTS (SELECT 1 FROM (SELECT account_id, merchant FROM p GROUP BY ALL HAVING COUNT(*) >= 2) g
              WHERE g.account_id = p.account_id AND g.merchant = p.merchant)""")
def q_frequent_merchant_rows(spark, sf_dir):
    return ins.frequent_merchant_rows(o_posted(spark, sf_dir), 2, ACCT).select("txn_id", "account_id", "merchant")


@register("month_over_month_by_account", _with(*O_POSTED, ("m", """
SELECT account_id, strftime(date, '%Y-%m') AS month, SUM(amount) AS s FROM p WHERE date IS NOT NULL GROUP BY ALL"""),
    ("w", """SELECT *, LAG(month) OVER (PARTITION BY account_id ORDER BY month) AS pm,
       LAG(s) OVER (PARTITION BY account_id ORDER BY month) AS ps,
       ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY month DESC) AS rn FROM m"""),
    ("x", f"""SELECT account_id, month, pm, s, ps,
       ({d('s')} - {d('ps')}) / {d('ps')} * 100 AS pct_signed FROM w WHERE rn = 1 AND pm IS NOT NULL""")) + f"""
SELECT account_id, month AS curr_month, {month_label_sql('month')} AS curr_label, {d('s')} AS curr_amount,
       pm AS prev_month, {month_label_sql('pm')} AS prev_label, {d('ps')} AS prev_amount,
       abs(pct_signed) AS pct, CASE WHEN pct_signed > 0 THEN 'up' ELSE 'down' END AS direction,
       'mom_' || CASE WHEN pct_signed > 0 THEN 'up' ELSE 'down' END AS card_type
FROM x""")
def q_month_over_month_by_account(spark, sf_dir):
    return ins.month_over_month(o_posted(spark, sf_dir), ACCT)


@register("largest_purchase_by_account", _with(*O_POSTED) + """
SELECT account_id, txn_id, date, merchant, description, category, CAST(amount AS DOUBLE) AS amount,
       strftime(date, '%b %d, %Y') AS date_label
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY amount DESC, date DESC NULLS LAST, txn_id) AS rn
      FROM p) t WHERE rn = 1""")
def q_largest_purchase_by_account(spark, sf_dir):
    return ins.largest_purchase(o_posted(spark, sf_dir), ACCT)


@register("largest_purchase", _with(*L_POSTED) + """
SELECT txn_id, date, merchant, description, category, CAST(amount AS DOUBLE) AS amount,
       strftime(date, '%b %d, %Y') AS date_label
FROM p ORDER BY amount DESC, date DESC NULLS LAST, txn_id LIMIT 1""")
def q_largest_purchase(spark, sf_dir):
    # FEED_L is not row-unique, but the top amount is.
    return ins.largest_purchase(l_posted(spark, sf_dir))


# ---------------------------------------------------------------------------
# The maintained dashboard (S6, S7, S14): four uploads are added, one is
# removed and one replaced; every result against the rows that are left.
# ---------------------------------------------------------------------------

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
KEPT = (*O_ALL, ("p", "SELECT * FROM feed_o WHERE txn_id % 4 <> 1"))
_STORES: dict[tuple[str, str], DashboardStore] = {}


def _maintained(spark: SparkSession, sf_dir: str) -> DashboardStore:
    """The store of this application and these tables; made once, all results read it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORES:
        store = DashboardStore(spark, scratch_path(spark, "dashboard"), ACCT)
        rows = feed_orders(spark, sf_dir)
        for k in range(4):
            part = rows.where(F.pmod("txn_id", F.lit(4)) == k)
            # the third upload comes with wrong amounts at first
            store.add(f"upload {k}", part.withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)")) if k == 2 else part)
        store.remove("upload 1")
        store.add("upload 2", rows.where(F.pmod("txn_id", F.lit(4)) == 2))
        _STORES[key] = store
    return _STORES[key]


@register("maintained_transactions", _with(*KEPT) + """
SELECT strftime(date, '%Y-%m-%d') AS date, merchant, description, CAST(amount AS DOUBLE) AS amount, category FROM p""")
def q_maintained_transactions(spark, sf_dir):
    return _maintained(spark, sf_dir).dashboard(SEGMENTS)["transactions"]


@register("maintained_category_totals", _with(*KEPT) + """
SELECT account_id, category, CAST(SUM(amount) AS DOUBLE) AS amount, COUNT(*) AS count FROM p GROUP BY ALL""")
def q_maintained_category_totals(spark, sf_dir):
    return _maintained(spark, sf_dir).category_totals()


@register("maintained_monthly_series", _with(*KEPT) + "SELECT account_id, strftime(date, '%Y-%m') AS month, " + ", ".join(
    f"CAST(COALESCE(SUM(amount) FILTER (WHERE category = '{c}'), 0) AS DOUBLE) AS \"{c}\"" for c in SEGMENTS) + " FROM p WHERE date IS NOT NULL GROUP BY ALL")
def q_maintained_monthly_series(spark, sf_dir):
    return _maintained(spark, sf_dir).monthly_series(SEGMENTS)


@register("maintained_metrics", _with(*KEPT) + METRICS_SQL.format(keys_sel="account_id,", group="GROUP BY account_id"))
def q_maintained_metrics(spark, sf_dir):
    return _maintained(spark, sf_dir).metrics()


@register("maintained_weekdays", _with(*KEPT)[:-1] + WEEKDAY_SQL.format(
    keys_sel="account_id,", keysrc="(SELECT DISTINCT account_id FROM p)", spine_keys="spine.account_id,", join_keys="AND spine.account_id = g.account_id"))
def q_maintained_weekdays(spark, sf_dir):
    return _maintained(spark, sf_dir).insights()["day_of_week"]


@register("maintained_recurring", _with(*KEPT, ("st", stats_sql("account_id", "merchant", "p"))) + recurring_sql("account_id", 3, "std_pop"))
def q_maintained_recurring(spark, sf_dir):
    return _maintained(spark, sf_dir).insights()["recurring"]


@register("maintained_largest_purchase", _with(*KEPT) + """
SELECT account_id, txn_id, date, merchant, description, category, CAST(amount AS DOUBLE) AS amount,
       strftime(date, '%b %d, %Y') AS date_label
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY amount DESC, date DESC NULLS LAST, txn_id) AS rn
      FROM p) t WHERE rn = 1""")
def q_maintained_largest_purchase(spark, sf_dir):
    return _maintained(spark, sf_dir).insights()["largest_purchase"]


# ---------------------------------------------------------------------------
# Exploration
# ---------------------------------------------------------------------------

@register("search_literal", _with(*O_POSTED) + """
SELECT txn_id, merchant, description FROM p
WHERE contains(lower(merchant), 'sq *') OR contains(lower(description), 'sq *')""")
def q_search_literal(spark, sf_dir):
    return ex.search(o_posted(spark, sf_dir), "SQ *").select("txn_id", "merchant", "description")


@register("search_regex", _with(*O_POSTED) + """
SELECT txn_id, merchant, description FROM p
WHERE regexp_matches(lower(merchant), 'u.*t') OR regexp_matches(lower(description), 'u.*t')""")
def q_search_regex(spark, sf_dir):
    return ex.search(o_posted(spark, sf_dir), "U.*T", regex=True).select("txn_id", "merchant", "description")


@register("filter_categories", _with(*O_POSTED) + """
SELECT txn_id, category, CAST(amount AS DOUBLE) AS amount FROM p WHERE category IN ('BUILDING', 'MACHINERY')""")
def q_filter_categories(spark, sf_dir):
    return ex.filter_categories(o_posted(spark, sf_dir), ["BUILDING", "MACHINERY"]).select(
        "txn_id", "category", F.col("amount").cast("double").alias("amount"))


@register("filter_summary", _with(*O_POSTED) + """
SELECT account_id,
       COUNT(*) FILTER (WHERE category IN ('BUILDING') AND (contains(lower(merchant), 'high') OR contains(lower(description), 'high'))) AS filtered_count,
       COUNT(*) AS total_count,
       CAST(COALESCE(SUM(amount) FILTER (WHERE category IN ('BUILDING') AND (contains(lower(merchant), 'high') OR contains(lower(description), 'high'))), 0) AS DOUBLE) AS filtered_total
FROM p GROUP BY account_id""")
def q_filter_summary(spark, sf_dir):
    pred = F.col("category").isin("BUILDING") & ex.search_predicate("HIGH")
    return agg.filter_summary(o_posted(spark, sf_dir), pred, ACCT)


@register("sort_page", _with(*O_POSTED) + """
SELECT txn_id, merchant, CAST(amount AS DOUBLE) AS amount FROM p
ORDER BY amount DESC, txn_id LIMIT 25 OFFSET 50""")
def q_sort_page(spark, sf_dir):
    return ex.page(o_posted(spark, sf_dir), 3, "amount").select(
        "txn_id", "merchant", F.col("amount").cast("double").alias("amount"))


@register("sort_page_merchant", _with(*O_POSTED) + """
SELECT txn_id, merchant, CAST(amount AS DOUBLE) AS amount FROM p
ORDER BY merchant ASC, txn_id LIMIT 25 OFFSET 25""")
def q_sort_page_merchant(spark, sf_dir):
    col, direction = ex.toggle_sort("date", "desc", "merchant")
    return ex.page(o_posted(spark, sf_dir), 2, col, direction).select(
        "txn_id", "merchant", F.col("amount").cast("double").alias("amount"))


@register("sort_page_locale", _with(*O_POSTED, ("x", """
SELECT txn_id, CASE WHEN txn_id % 2 = 0 THEN lower(merchant) ELSE merchant END AS merchant, amount FROM p""")) + """
SELECT txn_id, merchant, CAST(amount AS DOUBLE) AS amount FROM x
ORDER BY lower(merchant), merchant DESC, txn_id LIMIT 400 OFFSET 400""")
def q_sort_page_locale(spark, sf_dir):
    """O3 on text of mixed case: a letter's lower case goes before its upper case."""
    mixed = o_posted(spark, sf_dir).withColumn(
        "merchant", F.when(F.col("txn_id") % 2 == 0, F.lower("merchant")).otherwise(F.col("merchant")))
    return ex.page(mixed, 2, "merchant", "asc", size=400).select(
        "txn_id", "merchant", F.col("amount").cast("double").alias("amount"))


UNDATED = ("x", "SELECT txn_id, CASE WHEN txn_id % 3 <> 0 THEN date END AS date, amount FROM p")


def _page_after_first(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    """Second page by the key of the first one's last row; a third of the rows have no date."""
    rows = o_posted(spark, sf_dir).withColumn("date", F.when(F.col("txn_id") % 3 != 0, F.col("date")))
    shown = ex.page(rows, 1, "date", direction).select("txn_id", "date").collect()  # one page
    if not shown:
        return rows.select("txn_id", "date", F.col("amount").cast("double").alias("amount"))
    return ex.page_after(rows, shown[-1].asDict(), "date", direction).select(
        "txn_id", "date", F.col("amount").cast("double").alias("amount"))


@register("page_after_desc", _with(*O_POSTED, UNDATED) + """
SELECT txn_id, date, CAST(amount AS DOUBLE) AS amount FROM x ORDER BY date DESC NULLS LAST, txn_id LIMIT 25 OFFSET 25""")
def q_page_after_desc(spark, sf_dir):
    return _page_after_first(spark, sf_dir, "desc")


@register("page_after_asc", _with(*O_POSTED, UNDATED) + """
SELECT txn_id, date, CAST(amount AS DOUBLE) AS amount FROM x ORDER BY date ASC NULLS FIRST, txn_id LIMIT 25 OFFSET 25""")
def q_page_after_asc(spark, sf_dir):
    return _page_after_first(spark, sf_dir, "asc")


@register("page_count",_with(*O_POSTED) + """
SELECT account_id, COUNT(*) AS rows, greatest(1, CAST(ceil(COUNT(*) / 25) AS BIGINT)) AS pages
FROM p GROUP BY account_id""")
def q_page_count(spark, sf_dir):
    return ex.page_count(o_posted(spark, sf_dir), keys=ACCT)


# ---------------------------------------------------------------------------
# Classification
# ---------------------------------------------------------------------------

O_RULED = (*O_PREPARED, ("k", f"SELECT *, {rule_sql('merchant', 'parsed_description')} AS rule_cat FROM q"))


@register("categorize_rules", _with(*O_RULED) + """
SELECT txn_id, merchant, parsed_description, rule_cat AS category FROM k""")
def q_categorize_rules(spark, sf_dir):
    out = cls.categorize(o_prepared(spark, sf_dir).drop("category"), cls.seed_rules())
    return out.select("txn_id", "merchant", "parsed_description", "category")


@register("category_share_rules", _with(*O_RULED, ("g", "SELECT rule_cat AS category, SUM(amount) AS s FROM k GROUP BY 1")) + """
SELECT category, CAST(s AS DOUBLE) AS amount,
       CAST(s AS DOUBLE) / CAST(SUM(s) OVER () AS DOUBLE) * 100 AS pct,
       ROW_NUMBER() OVER (ORDER BY s DESC, category) AS rank
FROM g""")
def q_category_share_rules(spark, sf_dir):
    out = cls.categorize(o_prepared(spark, sf_dir).drop("category"), cls.seed_rules())
    return agg.category_share(out)


@register("category_share_rules_by_account", _with(*O_RULED, ("g", """
SELECT account_id, rule_cat AS category, SUM(amount) AS s FROM k GROUP BY ALL""")) + """
SELECT account_id, category, CAST(s AS DOUBLE) AS amount,
       CAST(s AS DOUBLE) / CAST(SUM(s) OVER (PARTITION BY account_id) AS DOUBLE) * 100 AS pct,
       ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY s DESC, category) AS rank
FROM g""")
def q_category_share_rules_by_account(spark, sf_dir):
    """A3/A4 keyed, with several categories per account."""
    out = cls.categorize(o_prepared(spark, sf_dir).drop("category"), cls.seed_rules())
    return agg.category_share(out, ACCT)


@register("dashboard_metrics", _with(*O_PREPARED, ("p2", f"SELECT account_id, amount, {rule_sql('merchant', 'parsed_description')} AS category FROM q"))
          + METRICS_SQL.format(keys_sel="account_id,", group="GROUP BY account_id").replace("FROM p ", "FROM p2 "))
def q_dashboard_metrics(spark, sf_dir):
    """The metrics of the dashboard bundle over the categorised set."""
    out = cls.categorize(o_prepared(spark, sf_dir).drop("category"), cls.seed_rules())
    return dashboard(out, ACCT, CATEGORIES, persist=False)["metrics"]


@register("coverage", _with(*O_RULED, ("pp", """
SELECT account_id, merchant, parsed_description, bool_or(rule_cat <> 'Uncategorized') AS ok FROM k GROUP BY ALL""")) + """
SELECT account_id, COUNT(*) FILTER (WHERE ok) AS done, COUNT(*) AS total FROM pp GROUP BY account_id""")
def q_coverage(spark, sf_dir):
    out = cls.categorize(o_prepared(spark, sf_dir).drop("category"), cls.seed_rules())
    return cls.coverage(out, ACCT)


@register("taxonomy_audit", _with(*O_POSTED) + f"""
SELECT category, COUNT(*) AS count FROM p
WHERE category NOT IN ({', '.join("'" + c + "'" for c in [*CATEGORIES, 'Uncategorized'])}) GROUP BY category""")
def q_taxonomy_audit(spark, sf_dir):
    # FEED_O carries market segments as labels: all of them fall outside.
    return cls.taxonomy_audit(o_posted(spark, sf_dir))


@register("taxonomy_audit_mixed", _with(*O_RULED, ("x", "SELECT CASE WHEN txn_id % 3 = 0 THEN category ELSE rule_cat END AS category FROM k")) + f"""
SELECT category, COUNT(*) AS count FROM x
WHERE category NOT IN ({', '.join("'" + c + "'" for c in [*CATEGORIES, 'Uncategorized'])}) GROUP BY category""")
def q_taxonomy_audit_mixed(spark, sf_dir):
    """U8 where two thirds of the rows carry labels of the taxonomy."""
    prepared = o_prepared(spark, sf_dir).withColumnRenamed("category", "segment")
    out = cls.with_rule_category(prepared).withColumn(
        "category", F.when(F.col("txn_id") % 3 == 0, F.col("segment")).otherwise(F.col("category")))
    return cls.taxonomy_audit(out)


def _cache_from_rules(prepared: DataFrame) -> DataFrame:
    """A cache built from the pairs of the 'HIGH'-priority orders: the
    pairs every later run finds already labelled."""
    seen = prepared.filter(F.col("merchant") == "2-HIGH")
    return cls.distinct_pairs(seen).withColumn("category", cls.rule_category(cls.classify_text()))


@register("cache_split", _with(*O_PREPARED, ("pairs", "SELECT DISTINCT merchant, parsed_description FROM q"),
                               ("cache", "SELECT DISTINCT merchant, parsed_description FROM q WHERE merchant = '2-HIGH'")) + """
SELECT merchant, parsed_description,
       EXISTS (SELECT 1 FROM cache c WHERE c.merchant = pairs.merchant
               AND c.parsed_description = pairs.parsed_description) AS cached
FROM pairs""")
def q_cache_split(spark, sf_dir):
    prepared = o_prepared(spark, sf_dir)
    pairs = cls.distinct_pairs(prepared)
    return cls.cache_labels(pairs, _cache_from_rules(prepared)).select(*cls.PAIR_KEYS, F.col("_hit").alias("cached"))


@register("cache_upsert", _with(*O_RULED, ("c", "SELECT DISTINCT merchant, parsed_description, rule_cat FROM k")) + """
SELECT merchant, parsed_description, CASE WHEN merchant = '2-HIGH' THEN 'Travel' ELSE rule_cat END AS category
FROM c WHERE merchant <> '5-LOW'""")
def q_cache_upsert(spark, sf_dir):
    """Two upserts into a versioned cache. The second one labels the
    '2-HIGH' pairs anew and adds those of '3-MEDIUM'; the newest label wins."""
    ruled = cls.with_rule_category(cls.distinct_pairs(o_prepared(spark, sf_dir)))
    root = scratch_path(spark, "category-cache")
    cache.upsert_cache(spark, root, ruled.filter(~F.col("merchant").isin("3-MEDIUM", "5-LOW")))
    later = ruled.filter(F.col("merchant").isin("2-HIGH", "3-MEDIUM"))
    cache.upsert_cache(spark, root, later.withColumn(
        "category", F.when(F.col("merchant") == "2-HIGH", F.lit("Travel")).otherwise(F.col("category"))))
    return cache.load_cache(spark, root)


@register("cache_compacted", _with(*O_RULED, ("c", "SELECT DISTINCT merchant, parsed_description, rule_cat FROM k")) + """
SELECT merchant, parsed_description, CASE WHEN length(parsed_description) % 2 = 0 THEN 'Travel' ELSE rule_cat END AS category FROM c""")
def q_cache_compacted(spark, sf_dir):
    """Seven upserts with a full copy after every second one, the last
    ones label half of the pairs anew; then vacuum."""
    ruled = cls.with_rule_category(cls.distinct_pairs(o_prepared(spark, sf_dir))).checkpoint()
    root = scratch_path(spark, "category-cache")
    for k in range(5):
        cache.upsert_cache(spark, root, ruled.where(F.pmod(F.xxhash64(*cls.PAIR_KEYS), F.lit(5)) == k), compact_every=2)
    anew = ruled.where(F.length("parsed_description") % 2 == 0).withColumn("category", F.lit("Travel"))
    for k in range(2):
        cache.upsert_cache(spark, root, anew.where(F.length("merchant") % 2 == k), compact_every=2)
    cache.vacuum_cache(spark, root)
    return cache.load_cache(spark, root)


@register("categorize_cached", _with(*O_RULED) + """
SELECT txn_id, merchant, parsed_description, rule_cat AS category FROM k""")
def q_categorize_cached(spark, sf_dir):
    """U1 with a cache that an earlier run has written: its label where it
    has one, the rules elsewhere."""
    prepared = o_prepared(spark, sf_dir).drop("category")
    root = scratch_path(spark, "category-cache")
    cache.upsert_cache(spark, root, _cache_from_rules(prepared))
    out = cls.categorize(prepared, cls.seed_rules(), cache=cache.load_cache(spark, root))
    return out.select("txn_id", "merchant", "parsed_description", "category")


O_BATCHED = (*O_PREPARED, ("pairs", "SELECT DISTINCT merchant, parsed_description FROM q"),
             ("rk", """SELECT *, ROW_NUMBER() OVER (ORDER BY merchant, parsed_description) AS rnk FROM pairs"""),
             ("bt", "SELECT merchant, parsed_description, (rnk - 1) // 20 AS batch_id, ((rnk - 1) % 20) + 1 AS position FROM rk"))


@register("build_prompts", _with(*O_BATCHED) + """
SELECT batch_id, COUNT(*) AS items,
       'Classify these transactions:' || chr(10) || string_agg(
           CAST(position AS VARCHAR) || '. Merchant: "' || merchant || '"  Description: "' || parsed_description || '"',
           chr(10) ORDER BY position) AS prompt,
       CAST(greatest(256, COUNT(*) * 40) AS BIGINT) AS max_tokens
FROM bt GROUP BY batch_id""")
def q_build_prompts(spark, sf_dir):
    batched = cls.assign_batches(cls.distinct_pairs(o_prepared(spark, sf_dir)), 20)
    return cls.build_prompts(batched)


@register("parse_replies", _with(*O_BATCHED) + f"""
SELECT batch_id, position, merchant, parsed_description,
       CASE WHEN batch_id % 7 = 3 OR position = 5 THEN 'Uncategorized'
            ELSE {rule_sql('merchant', 'parsed_description')} END AS category,
       NOT (batch_id % 7 = 3 OR position = 5) AS answered
FROM bt""")
def q_parse_replies(spark, sf_dir):
    """Replies derived from the data: every 7th batch (id ≡ 3) comes back
    wrapped in non-JSON text (malformed), and in every batch the 5th echo
    alters the merchant name; both leave their pairs Uncategorized. Every
    pair is echoed twice, with another label at first: the last one counts."""
    batched = cls.assign_batches(cls.distinct_pairs(o_prepared(spark, sf_dir)), 20)
    echoed = batched.withColumn(
        "merchant", F.when(F.col("position") == 5, F.concat(F.lit("ALTERED "), F.col("merchant")))
        .otherwise(F.col("merchant")))
    said = cls.rule_replies(echoed).withColumn("said", F.from_json("reply", REPLY_SCHEMA)["results"])
    first = F.transform("said", lambda e: F.struct(e["merchant"].alias("merchant"), e["description"].alias("description"), F.lit("Travel").alias("category")))
    last = F.transform("said", lambda e: F.struct(e["merchant"].alias("merchant"), e["description"].alias("description"), e["category"].alias("category")))
    replies = said.select("batch_id", F.to_json(F.struct(F.concat(first, last).alias("results"))).alias("reply"))
    damaged = replies.select(
        "batch_id",
        F.when(F.col("batch_id") % 7 == 3, F.concat(F.lit("<error>"), F.col("reply"), F.lit("</error>")))
        .otherwise(F.col("reply")).alias("reply"))
    return cls.parse_replies(damaged, batched)


def _length_classifier(prompt: str, items: list[dict]) -> dict:
    """A deterministic stand-in for a hosted model: labels a pair by the
    length of its description."""
    return {"results": [
        {"merchant": it["merchant"], "description": it["description"],
         "category": CATEGORIES[len(it["description"] or "") % len(CATEGORIES)]}
        for it in items]}


@register("categorize_batch", _with(*O_PREPARED) + f"""
SELECT txn_id, merchant, parsed_description,
       list_extract({'[' + ', '.join("'" + c + "'" for c in CATEGORIES) + ']'}, (length(parsed_description) % 8) + 1) AS category
FROM q""")
def q_categorize_batch(spark, sf_dir):
    """The pluggable batch classifier (20 pairs per call) end to end."""
    out = cls.categorize(o_prepared(spark, sf_dir).drop("category"),
                         cls.BatchClassifier(_length_classifier, batch_size=20))
    return out.select("txn_id", "merchant", "parsed_description", "category")


def _rejecting_classifier(prompt: str, items: list[dict]) -> dict:
    """As ``_length_classifier``, but its account is closed for some requests."""
    if items[0]["merchant"] == "4-NOT SPECIFIED":
        raise cls.PermanentClassifierError("account closed")
    return _length_classifier(prompt, items)


def _travel_classifier(prompt: str, items: list[dict]) -> dict:
    return {"results": [{**it, "category": "Travel"} for it in items]}


@register("categorize_resumed", _with(*O_BATCHED, ("answer", """
SELECT bt.merchant, bt.parsed_description, h.merchant = '4-NOT SPECIFIED' AS rejected
FROM bt JOIN (SELECT batch_id, merchant FROM bt WHERE position = 1) h USING (batch_id)""")) + f"""
SELECT txn_id, q.merchant, q.parsed_description,
       CASE WHEN rejected THEN 'Travel' ELSE
       list_extract({'[' + ', '.join("'" + c + "'" for c in CATEGORIES) + ']'}, (length(q.parsed_description) % 8) + 1) END AS category
FROM q JOIN answer ON q.merchant = answer.merchant AND q.parsed_description = answer.parsed_description""")
def q_categorize_resumed(spark, sf_dir):
    """A run that fails for good on some batches, and a second one
    with another classifier: it is asked for the pairs of those batches only,
    the answers of the first run are taken from its journal."""
    prepared = o_prepared(spark, sf_dir).drop("category")
    root = scratch_path(spark, "resumed-cache")
    try:
        cls.categorize(prepared, cls.BatchClassifier(_rejecting_classifier, journal_every=1), cache_root=root)
    except cls.PermanentClassifierError:
        pass  # on tables without such pairs the first run answers everything
    out = cls.categorize(prepared, cls.BatchClassifier(_travel_classifier), cache=cache.load_cache(spark, root), cache_root=root)
    return out.select("txn_id", "merchant", "parsed_description", "category")


@register("categorize_one_pair", _with(*O_RULED, ("best", "SELECT merchant, parsed_description, COUNT(*) AS n FROM q GROUP BY ALL"),
                                       ("one", "SELECT * FROM best ORDER BY n DESC, merchant, parsed_description LIMIT 1")) + f"""
SELECT merchant, parsed_description, {rule_sql('merchant', 'parsed_description')} AS category FROM one""")
def q_categorize_one_pair(spark, sf_dir):
    """The pair that most rows have, through the path of one pair."""
    pairs = o_prepared(spark, sf_dir).groupBy(*cls.PAIR_KEYS).agg(F.count(F.lit(1)).alias("n"))
    top = pairs.orderBy(F.desc("n"), *cls.PAIR_KEYS).first()
    return cls.categorize_one(spark, top["merchant"], top["parsed_description"], cache_root=scratch_path(spark, "one-pair"))


# ---------------------------------------------------------------------------
# Formatting and sinks
# ---------------------------------------------------------------------------

def compact_sql(v: str) -> str:
    x = f"CAST({v} AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) >= 1000000 THEN '$' || printf('%.1f', {x} / 1000000) || 'M' "
            f"WHEN abs({x}) >= 1000 THEN '$' || printf('%.0f', {x} / 1000) || 'k' "
            f"ELSE '$' || format('{{:,.0f}}', {x}) END)")


@register("format_labels", _with(*O_POSTED) + f"""
SELECT txn_id, strftime(date, '%Y-%m-%d') AS iso_date, strftime(date, '%b %d, %Y') AS long_date,
       {month_label_sql("strftime(date, '%Y-%m')")} AS month_label, strftime(date, '%b') AS month_axis,
       list_extract(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'], isodow(date)) AS weekday,
       {compact_sql('amount')} AS compact, {compact_sql('amount * 10')} AS compact_big,
       {compact_sql('CAST(amount AS DOUBLE) / 1000')} AS compact_small,
       '$' || format('{{:,.2f}}', amount) AS currency
FROM p""")
def q_format_labels(spark, sf_dir):
    o = o_posted(spark, sf_dir)
    m = prep.month_key("date")
    return o.select(
        "txn_id",
        fmt.iso_date("date").alias("iso_date"),
        fmt.long_date("date").alias("long_date"),
        fmt.month_label(m).alias("month_label"),
        fmt.month_axis(m).alias("month_axis"),
        fmt.weekday_name(fmt.weekday_index("date")).alias("weekday"),
        fmt.fmt_compact("amount").alias("compact"),
        fmt.fmt_compact(F.col("amount") * 10).alias("compact_big"),
        fmt.fmt_compact(F.col("amount").cast("double") / 1000).alias("compact_small"),
        fmt.fmt_currency("amount").alias("currency"),
    )


@register("export_lines", _with(*O_POSTED) + """
SELECT txn_id, strftime(date, '%Y-%m-%d') || ',"' || replace(merchant, '"', '""') || '","'
       || replace(description, '"', '""') || '",' || printf('%.2f', amount) || ',' || category AS line
FROM p""")
def q_export_lines(spark, sf_dir):
    return sinks.export_lines(o_posted(spark, sf_dir))


@register("records", _with(*O_POSTED) + """
SELECT strftime(date, '%Y-%m-%d') AS date, merchant, description, CAST(amount AS DOUBLE) AS amount, category FROM p""")
def q_records(spark, sf_dir):
    return sinks.to_records(o_posted(spark, sf_dir), include_category=True)


# ---------------------------------------------------------------------------
# CSV sources end to end (S1–S5, R1, R2): FEED_O written as export files in
# the shared scratch folder, read back by the export reader / file stream.
# ---------------------------------------------------------------------------

EXPORT_A_HEADER = ["Date", "Amount", "Cardholder", "Merchant", "Description", "Status", "Type"]
EXPORT_B_HEADER = ["Transaction Date", "Posted Date", "Card No.", "Description", "Category", "Debit"]


def _write_exports(spark: SparkSession, sf_dir: str) -> str:
    """Dialect-A files (no Time column) and dialect-B files (extra
    card-number column) side by side, with one header per file. The cells
    of Cardholder and Card No. hold commas, quotes and line breaks."""
    base = scratch_path(spark, "exports")
    odd = F.concat(F.lit('Doe, "J"\n'), F.col("txn_id").cast("string"), F.lit(",x"))
    a = orders_as_dialect_a(spark, sf_dir).withColumn("Cardholder", odd).select(*EXPORT_A_HEADER)
    b = orders_as_dialect_b(spark, sf_dir).withColumn("Card No.", odd).select(*[F.col(f"`{c}`") for c in EXPORT_B_HEADER])
    opts = {"header": True, "escape": '"', "quoteAll": False,
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    a.write.options(**opts).csv(f"{base}/acct=a")
    b.write.options(**opts).csv(f"{base}/acct=b")
    return base


EXPORT_OUT = ["dialect", "date", "amount", "merchant", "description", "status", "type"]


@register("read_exports_roundtrip", _with(*O_ALL) + f"""
SELECT 'A' AS dialect, date, CAST(amount AS DOUBLE) AS amount, merchant, description, status, type FROM feed_o
UNION ALL
SELECT 'B' AS dialect, date,
       CASE WHEN status = 'Pending' THEN 0.0 ELSE CAST(amount AS DOUBLE) END AS amount,
       {display_sql('description')} AS merchant, description, 'Posted' AS status,
       CASE WHEN status = 'Pending' OR amount = 0 OR merchant = '5-LOW' THEN 'Payment' ELSE 'Purchase' END AS type
FROM feed_o""")
def q_read_exports_roundtrip(spark, sf_dir):
    base = _write_exports(spark, sf_dir)
    out = exports.read_exports(spark, f"{base}/*", account_pattern=r"acct=([^/]+)")
    return out.select("dialect", "date", F.col("amount").cast("double").alias("amount"),
                      "merchant", "description", "status", "type")


B_PREPARED = (("b", f"""
SELECT date, amount, {display_sql('description')} AS merchant, description FROM feed_o
WHERE status <> 'Pending' AND amount > 0 AND merchant <> '5-LOW'"""),
              ("qb", f"SELECT *, strftime(date, '%Y-%m') AS month, {clean_sql('merchant', 'description')} AS parsed_description FROM b"))


def _export_stream(spark: SparkSession, base: str, account: str, header: list[str], dialect: str) -> DataFrame:
    from ledgerlens.streaming import ingest
    return ingest.stream_exports(spark, f"{base}/acct={account}", header, dialect)


@register("stream_attach", _with(*O_RULED, ("x", "SELECT CASE WHEN merchant = '2-HIGH' THEN rule_cat ELSE 'Uncategorized' END AS category, amount FROM k")) + """
SELECT category, CAST(SUM(amount) AS DOUBLE) AS amount, COUNT(*) AS count FROM x GROUP BY category""")
def q_stream_attach(spark, sf_dir):
    """R2: a stream of dialect-A exports joined with a cache that an earlier
    run has written; pairs that it lacks stay Uncategorized."""
    from ledgerlens.streaming import ingest
    root = scratch_path(spark, "category-cache")
    cache.upsert_cache(spark, root, _cache_from_rules(o_prepared(spark, sf_dir)))
    rows = _export_stream(spark, _write_exports(spark, sf_dir), "a", EXPORT_A_HEADER, exports.DIALECT_A)
    out = scratch_path(spark, "stream-attach")
    q = ingest.start_append(ingest.categorize_stream(rows, cache.load_cache(spark, root)).select("category", "amount"), f"{out}/out", f"{out}/chk")
    q.awaitTermination()
    return agg.category_totals(spark.read.parquet(f"{out}/out"))


@register("stream_exports_running", _with(*O_PREPARED, *B_PREPARED, ("k", f"""
SELECT month, {rule_sql('merchant', 'parsed_description')} AS rule_cat, amount FROM q
UNION ALL SELECT month, {rule_sql('merchant', 'parsed_description')} AS rule_cat, amount FROM qb""")) + """
SELECT month, rule_cat AS category, CAST(SUM(amount) AS DOUBLE) AS amount, COUNT(*) AS count FROM k GROUP BY ALL""")
def q_stream_exports_running(spark, sf_dir):
    """The export files of both dialects as file streams, cleaned
    and rule-categorised row by row, running month × category totals."""
    from ledgerlens.streaming import ingest
    base = _write_exports(spark, sf_dir)
    rows = [_export_stream(spark, base, *layout) for layout in (
        ("a", EXPORT_A_HEADER, exports.DIALECT_A), ("b", EXPORT_B_HEADER, exports.DIALECT_B))]
    stream = ingest.categorize_stream(rows[0].unionByName(rows[1]))
    out_base = scratch_path(spark, "stream-exports")
    q = ingest.start_upserts(ingest.running_totals(stream), f"{out_base}/out", f"{out_base}/chk", keys=["month", "category"])
    q.awaitTermination()
    out = ingest.latest_upserts(spark, f"{out_base}/out", ["month", "category"])
    return out.select("month", "category", F.col("amount").cast("double").alias("amount"),
                      F.col("count").cast("bigint").alias("count"))


@register("category_bars", _with(*L_POSTED) + """
SELECT category, CAST(SUM(amount) AS DOUBLE) AS amount, COUNT(*) AS count FROM p GROUP BY category""")
def q_category_bars(spark, sf_dir):
    return agg.category_totals(l_posted(spark, sf_dir), ascending=True)


@register("category_share_by_account", _with(*O_POSTED, ("g", "SELECT account_id, category, SUM(amount) AS s FROM p GROUP BY ALL")) + """
SELECT account_id, category, CAST(s AS DOUBLE) AS amount,
       CAST(s AS DOUBLE) / CAST(SUM(s) OVER (PARTITION BY account_id) AS DOUBLE) * 100 AS pct,
       ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY s DESC, category) AS rank
FROM g""")
def q_category_share_by_account(spark, sf_dir):
    return agg.category_share(o_posted(spark, sf_dir), ACCT)


@register("monthly_wide_by_account", _with(*O_POSTED) + "SELECT account_id, strftime(date, '%Y-%m') AS month, " + ", ".join(
    f"CAST(COALESCE(SUM(amount) FILTER (WHERE category = '{c}'), 0) AS DOUBLE) AS \"{c}\""
    for c in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    + " FROM p WHERE date IS NOT NULL GROUP BY ALL")
def q_monthly_wide_by_account(spark, sf_dir):
    # Market segments given up front: one pass, no distinct job first.
    return agg.monthly_wide(o_posted(spark, sf_dir),
                            ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], ACCT)


@register("recurring_suppliers", _with(*L_POSTED, ("st", stats_sql("''", "merchant", "p"))) + """
SELECT name, count, avg, total FROM st
WHERE count >= 3 AND (COALESCE(std_pop < avg * 0.25, false) OR distinct_amounts <= 2)""")
def q_recurring_suppliers(spark, sf_dir):
    """A10 single-session over the line-item feed (merchant = supplier)."""
    return ins.recurring(l_posted(spark, sf_dir))


# ---------------------------------------------------------------------------
# Streaming (R1–R5) over FEED_E, run to completion with availableNow
# ---------------------------------------------------------------------------

def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table is one file or a folder of part files. A file stream takes a
    # path without wildcard for a folder; [t] lets it take either.
    path = f"{sf_dir.rstrip('/')}/events.parque"
    stream = (spark.readStream.schema(spark.read.parquet(path + "t").schema)
              .option("maxFilesPerTrigger", 1).parquet(path + "[t]"))
    return stream.select(
        F.col("user_id").cast("string").alias("account_id"),
        F.col("event_id").alias("txn_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("ts").cast("date").alias("date"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.col("event_type").alias("category"),
    )


@register("stream_daily", _with(*E_ALL, ("g", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start,
       CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS window_end,
       CAST(SUM(amount) AS DOUBLE) AS amount, COUNT(*) AS count
FROM feed_e GROUP BY 1, 2""")) + """
SELECT window_start, window_end, amount, count FROM g
WHERE window_end <= (SELECT MAX(ts) FROM feed_e) - INTERVAL 1 DAY""")
def q_stream_daily(spark, sf_dir):
    """Append-mode daily totals behind a 1-day watermark; the days the
    watermark has not passed yet are still open and not emitted."""
    from ledgerlens.streaming import ingest
    base = scratch_path(spark, "stream-daily")
    q = ingest.start_append(ingest.daily_totals_watermarked(_events_stream(spark, sf_dir)),
                            f"{base}/out", f"{base}/chk")
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      F.col("amount").cast("double").alias("amount"),
                      F.col("count").cast("bigint").alias("count"))


@register("stream_running", _with(*E_ALL) + """
SELECT strftime(date, '%Y-%m') AS month, category, CAST(SUM(amount) AS DOUBLE) AS amount, COUNT(*) AS count
FROM feed_e GROUP BY ALL""")
def q_stream_running(spark, sf_dir):
    """Running month × category totals in update mode, kept as an
    upsert log; the read side takes each key's latest row."""
    from ledgerlens.streaming import ingest
    base = scratch_path(spark, "stream-running")
    q = ingest.start_upserts(ingest.running_totals(_events_stream(spark, sf_dir)),
                             f"{base}/out", f"{base}/chk", keys=["month", "category"])
    q.awaitTermination()
    out = ingest.latest_upserts(spark, f"{base}/out", ["month", "category"])
    return out.select("month", "category", F.col("amount").cast("double").alias("amount"),
                      F.col("count").cast("bigint").alias("count"))



@register("stream_progress", "SELECT COUNT(*) AS input_rows FROM events")
def q_stream_progress(spark, sf_dir):
    """The progress reports of the daily-totals stream over the events
    table; the input rows of its micro-batches add up to the table."""
    from ledgerlens.streaming import ingest
    base = scratch_path(spark, "stream-progress")
    log = ingest.ProgressLog(spark, f"{base}/progress")
    spark.streams.addListener(log)
    try:
        q = ingest.start_append(ingest.daily_totals_watermarked(_events_stream(spark, sf_dir)),
                                f"{base}/out", f"{base}/chk")
        q.awaitTermination()
        prog = log.reports(q)
    finally:
        spark.streams.removeListener(log)
    return prog.agg(F.sum("input_rows").cast("bigint").alias("input_rows"))


# ---------------------------------------------------------------------------
# Streams with state (R1–R4): several micro-batches, real late rows
# ---------------------------------------------------------------------------

# Events arrive in six files by their day; every tenth one two files later.
ARRIVAL = "least(floor((day(ts) - 1) / 6) + (CASE WHEN event_id % 10 = 3 THEN 2 ELSE 0 END), 5)"


def _arriving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of six files, one per micro-batch."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"), F.col("value").cast("decimal(18,2)").alias("amount"))
    folder = scratch_path(spark, "arriving")
    for k in range(6):  # a file stream takes files in the order of their times
        events.where(F.expr(ARRIVAL) == k).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


E_ARRIVING = (("a", f"""
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS category, CAST(value AS DECIMAL(18,2)) AS amount, CAST({ARRIVAL} AS INTEGER) AS part FROM events"""),
              ("tops", "SELECT part, MAX(ts) AS top FROM a GROUP BY part"),
              ("marks", "SELECT parts.part, MAX(tops.top) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT part FROM a) parts LEFT JOIN tops ON tops.part < parts.part GROUP BY parts.part"),
              ("x", "SELECT a.*, COALESCE(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late FROM a JOIN marks USING (part)"))


@register("stream_late_ledger", _with(*E_ARRIVING) + """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CAST(COALESCE(SUM(amount) FILTER (WHERE NOT late), 0) AS DOUBLE) AS amount, COUNT(*) FILTER (WHERE NOT late) AS count,
       CAST(COALESCE(SUM(amount) FILTER (WHERE late), 0) AS DOUBLE) AS late_amount, COUNT(*) FILTER (WHERE late) AS late_count
FROM x GROUP BY 1""")
def q_stream_late_ledger(spark, sf_dir):
    """What came in time for each day and what came when it was over."""
    from ledgerlens.streaming import stateful
    base = scratch_path(spark, "stream-late")
    stateful.start_daily_ledger(_arriving_events(spark, sf_dir), f"{base}/out", f"{base}/chk").awaitTermination()
    return stateful.daily_ledger(spark, f"{base}/out").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("amount").cast("double").alias("amount"), "count",
        F.col("late_amount").cast("double").alias("late_amount"), "late_count")


@register("stream_closing_months", _with(*E_ARRIVING) + """
SELECT strftime(ts, '%Y-%m') AS month, category, CAST(SUM(amount) AS DOUBLE) AS amount, COUNT(*) AS count FROM a GROUP BY ALL""")
def q_stream_closing_months(spark, sf_dir):
    """Running totals whose months leave the state when they are over."""
    from ledgerlens.streaming import stateful
    base = scratch_path(spark, "stream-months")
    stateful.start_closing_totals(_arriving_events(spark, sf_dir), f"{base}/out", f"{base}/chk").awaitTermination()
    return stateful.month_totals(spark, f"{base}/out").select("month", "category", F.col("amount").cast("double").alias("amount"), "count")


@register("stream_live_cache", _with(*O_RULED) + """
SELECT txn_id, merchant, parsed_description, CASE WHEN merchant = '5-LOW' THEN 'Uncategorized' ELSE rule_cat END AS category FROM k""")
def q_stream_live_cache(spark, sf_dir):
    """R2: transactions in four micro-batches under a cache that grows in
    two; the labels of two merchants come after their first rows, those of one never."""
    from ledgerlens.streaming import stateful
    base = scratch_path(spark, "stream-live")
    prepared = cls.with_rule_category(o_prepared(spark, sf_dir)).select("merchant", "parsed_description", "txn_id", "category").checkpoint()
    labels = prepared.drop("txn_id").distinct().withColumn("version", F.lit(1).cast("long"))
    for k in range(4):
        prepared.where(F.pmod("txn_id", F.lit(4)) == k).drop("category").coalesce(1).write.mode("append").parquet(f"{base}/rows")
    later = F.col("merchant").isin("1-URGENT", "2-HIGH")
    labels.where(~later & (F.col("merchant") != "5-LOW")).coalesce(1).write.mode("append").parquet(f"{base}/labels")
    labels.where(later).coalesce(1).write.mode("append").parquet(f"{base}/labels")
    rows, changes = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}") for df, name in ((prepared.drop("category"), "rows"), (labels, "labels")))
    stateful.start_live_categories(rows, changes, f"{base}/out", f"{base}/chk").awaitTermination()
    return stateful.latest_categories(spark, f"{base}/out").drop("corrected")


@register("stream_mixed_folder", _with(*O_ALL) + f"""
SELECT 'A' AS dialect, COUNT(*) AS rows, CAST(SUM(amount) AS DOUBLE) AS amount FROM feed_o WHERE {POSTED}
UNION ALL
SELECT 'B' AS dialect, COUNT(*) AS rows, CAST(SUM(amount) AS DOUBLE) AS amount FROM feed_o WHERE status <> 'Pending' AND amount > 0 AND merchant <> '5-LOW'
UNION ALL
SELECT 'quarantined files' AS dialect, 1 AS rows, 0.0 AS amount""")
def q_stream_mixed_folder(spark, sf_dir):
    """One stream over a folder with exports of both dialects and a file of another kind."""
    from ledgerlens.streaming import stateful
    base = _write_exports(spark, sf_dir)
    feed_orders(spark, sf_dir).select("txn_id", "merchant").coalesce(1).write.option("header", True).csv(f"{base}/acct=x")
    out = scratch_path(spark, "stream-folder")
    stateful.start_folder(spark, f"{base}/*", f"{out}/out", f"{out}/chk", max_files_per_trigger=4).awaitTermination()
    rows = spark.read.parquet(f"{out}/out/rows").groupBy("dialect").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").cast("double").alias("amount"))
    bad = spark.read.parquet(f"{out}/out/quarantine").agg(F.count(F.lit(1)).alias("rows"))
    return rows.unionByName(bad.select(F.lit("quarantined files").alias("dialect"), "rows", F.lit(0.0).alias("amount")))


# ---------------------------------------------------------------------------
# Indexes (O3/O6, P10, U2) and sketches
# ---------------------------------------------------------------------------

@register("order_index_page", _with(*O_ALL) + """
SELECT txn_id, date, merchant, CAST(amount AS DOUBLE) AS amount FROM feed_o
ORDER BY amount DESC, txn_id LIMIT 10 OFFSET (SELECT 10 * (COUNT(*) // 10 - 101) FROM feed_o)""")
def q_order_index_page(spark, sf_dir):
    """A page of ten rows 100 pages before the end, by the order index."""
    root = scratch_path(spark, "order-index")
    indexes.build_order_index(feed_orders(spark, sf_dir), root, "amount", "desc", parts=16)
    last = spark.read.parquet(f"{root}/prefix").agg(F.sum("rows")).first()[0] // 10
    return indexes.indexed_page(spark, root, last - 100, 10).select("txn_id", "date", "merchant", F.col("amount").cast("double").alias("amount"))


@register("search_indexed", _with(*O_POSTED) + """
SELECT txn_id, merchant, description FROM p
WHERE contains(lower(merchant), 'spotify p3') OR contains(lower(description), 'spotify p3')""")
def q_search_indexed(spark, sf_dir):
    """P10 by the trigram index."""
    root = scratch_path(spark, "search-index")
    indexes.build_search_index(o_posted(spark, sf_dir).select("txn_id", "merchant", "description"), root)
    return indexes.indexed_search(spark, root, "Spotify P3")


RULE_TABLE = (("rules", """
SELECT s_suppkey AS priority, lower(split_part(s_name, '#', 2)) AS phrase, s_suppkey % 8 AS kind FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL
SELECT 1000000 + p_partkey AS priority, lower(split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2)) AS phrase, p_partkey % 8 AS kind FROM part WHERE contains(p_name, ' ')"""),
              ("first", "SELECT phrase, MIN(priority) AS priority, arg_min(kind, priority) AS kind FROM rules GROUP BY phrase"),
              ("pairs", "SELECT DISTINCT merchant, description AS parsed_description FROM feed_l"),
              ("w", """SELECT *, list_filter(regexp_split_to_array(regexp_replace(lower(merchant || ' ' || parsed_description), '([^\\w\\s])', ' \\1 ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM pairs"""),
              ("g", """SELECT merchant, parsed_description, unnest(w) AS gram FROM w
                       UNION ALL SELECT merchant, parsed_description, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w"""),
              ("hit", "SELECT merchant, parsed_description, arg_min(kind, (priority, phrase)) AS kind FROM g JOIN first ON gram = phrase GROUP BY ALL"))


@register("rules_indexed", _with(("feed_l", FEED_L_SQL), *RULE_TABLE) + f"""
SELECT pairs.merchant, pairs.parsed_description,
       COALESCE(list_extract({'[' + ', '.join("'" + c + "'" for c in CATEGORIES) + ']'}, CAST(kind AS INTEGER) + 1), 'Uncategorized') AS category
FROM pairs LEFT JOIN hit ON pairs.merchant = hit.merchant AND pairs.parsed_description = hit.parsed_description""")
def q_rules_indexed(spark, sf_dir):
    """A rule per supplier and per beginning of a part's name, looked up by word n-grams."""
    label = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("kind") + 1).cast("int"))
    s, p = (spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ("supplier", "part"))
    suppliers = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("long").alias("priority"), F.element_at(F.split("s_name", "#"), 2).alias("pattern"), (F.col("s_suppkey") % 8).alias("kind"))
    words = F.split("p_name", " ")
    parts = p.where(F.col("p_name").contains(" ")).select((F.col("p_partkey") + 1_000_000).cast("long").alias("priority"), F.concat_ws(" ", words[0], words[1]).alias("pattern"), (F.col("p_partkey") % 8).alias("kind"))
    phrases, _ = cls.phrase_rules(suppliers.unionByName(parts).select("priority", "pattern", label.alias("category")))
    pairs = feed_lineitem(spark, sf_dir).select("merchant", F.col("description").alias("parsed_description"))
    return cls.indexed_rule_category(pairs, phrases)


@register("merchant_count_sketched", _with(*L_POSTED) + """
SELECT strftime(date, '%Y') AS year, COUNT(DISTINCT merchant) AS merchants, true AS within FROM p GROUP BY 1""")
def q_merchant_count_sketched(spark, sf_dir):
    """Monthly sketches united to years; ``within`` tells whether the
    estimate lies within four standard errors of the exact count."""
    rows = l_posted(spark, sf_dir)
    year = F.substring("month", 1, 4).alias("year")
    estimate = agg.approx_merchant_count(agg.merchant_sketches(rows).select(year, "sketch"), ["year"])
    exact = rows.groupBy(F.date_format("date", "yyyy").alias("year")).agg(F.count_distinct("merchant").alias("merchants"))
    return exact.join(estimate, "year").select("year", "merchants", (F.abs(F.col("merchant_count") - F.col("merchants")) <= F.col("merchants") * (4 * 1.04 / 64)).alias("within"))
