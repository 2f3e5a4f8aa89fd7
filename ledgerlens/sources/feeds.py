"""Adapters from the driver's parquet tables to the transaction schema.

FEED_O  orders ⋈ customer      row-level queries (o_orderkey is unique)
FEED_L  lineitem ⋈ part ⋈ supplier   aggregates only
FEED_E  events                 streaming / retention

Every adapter is a lazy projection over a parquet scan, so filters and
column pruning of the query on top reach the scan. The matching DuckDB
text for each feed lives next to it (``*_SQL``) so the oracles build the
very same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schema import AMOUNT_TYPE

# Descriptor pieces for FEED_O. A description is
# prefix[k % 6] || name[(k div 6) % 16] || suffix[(k div 96) % 6], k = o_orderkey.
DESC_PREFIXES = ["SQ *", "TST* ", "PAYPAL *", "PAR ", "amzn ", ""]
DESC_NAMES = [
    "Blue Bottle Coffee", "Spotify", "UBER *EATS", "Shell Oil 5531",
    "WHOLE FOODS MARKET", "STARBUCKS", "Uber Trip", "Hudson News",
    "Target", "AMC Movie Theater", "Late Fee", "CVS Pharmacy",
    "Delta Airlines", "Costco Electronics", "Parking Garage", "Corner Bar",
]
DESC_SUFFIXES = [" HOUSTON TX", " P3DCEA9B48", " x.com/bill", "  ", " MINATO JP", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx.cast("int") + 1)


def descriptor(key: Column) -> Column:
    n, t, m = len(DESC_PREFIXES), len(DESC_NAMES), len(DESC_SUFFIXES)
    return F.concat(
        _pick(DESC_PREFIXES, key % n),
        _pick(DESC_NAMES, F.floor(key / n) % t),
        _pick(DESC_SUFFIXES, F.floor(key / (n * t)) % m),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def descriptor_sql(key: str) -> str:
    n, t, m = len(DESC_PREFIXES), len(DESC_NAMES), len(DESC_SUFFIXES)
    return (
        f"(list_extract({_sql_list(DESC_PREFIXES)}, ({key} % {n}) + 1) || "
        f"list_extract({_sql_list(DESC_NAMES)}, (({key} // {n}) % {t}) + 1) || "
        f"list_extract({_sql_list(DESC_SUFFIXES)}, (({key} // {n * t}) % {m}) + 1))"
    )


def feed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEED_O: one row per order; account = customer, merchant = order
    priority, category = market segment (pre-attached)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        o.join(c, o.o_custkey == c.c_custkey, "inner")
        .select(
            F.col("o_custkey").cast("string").alias("account_id"),
            F.col("o_orderkey").alias("txn_id"),
            F.concat(F.lit("export_"), F.substring("o_orderpriority", 1, 1), F.lit(".csv")).alias("source_file"),
            F.lit("A").alias("dialect"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.lit("").alias("time"),
            F.col("o_totalprice").cast(AMOUNT_TYPE).alias("amount"),
            F.col("o_orderpriority").alias("merchant"),
            descriptor(F.col("o_orderkey")).alias("description"),
            F.when(F.col("o_orderstatus") == "F", "Posted").otherwise("Pending").alias("status"),
            F.lit("Purchase").alias("type"),
            F.col("c_mktsegment").alias("category"),
        )
    )


FEED_O_SQL = f"""
SELECT CAST(o_custkey AS VARCHAR) AS account_id,
       o_orderkey AS txn_id,
       'export_' || substr(o_orderpriority, 1, 1) || '.csv' AS source_file,
       'A' AS dialect,
       CAST(o_orderdate AS DATE) AS date,
       '' AS time,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
       o_orderpriority AS merchant,
       {descriptor_sql('o_orderkey')} AS description,
       CASE WHEN o_orderstatus = 'F' THEN 'Posted' ELSE 'Pending' END AS status,
       'Purchase' AS type,
       c_mktsegment AS category
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def feed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEED_L: one row per line item; merchant = supplier, description =
    part name, category = part type. Not row-unique; aggregates only."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return (
        li.join(p, li.l_partkey == p.p_partkey, "inner")
        .join(s, li.l_suppkey == s.s_suppkey, "inner")
        .select(
            F.lit("").alias("account_id"),
            F.col("l_orderkey").alias("txn_id"),
            F.lit("lineitem.csv").alias("source_file"),
            F.lit("A").alias("dialect"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.lit("").alias("time"),
            F.col("l_extendedprice").cast(AMOUNT_TYPE).alias("amount"),
            F.col("s_name").alias("merchant"),
            F.col("p_name").alias("description"),
            F.when(F.col("l_linestatus") == "F", "Posted").otherwise("Pending").alias("status"),
            F.when(F.col("l_returnflag") == "R", "Refund").otherwise("Purchase").alias("type"),
            F.col("p_type").alias("category"),
        )
    )


FEED_L_SQL = """
SELECT '' AS account_id,
       l_orderkey AS txn_id,
       'lineitem.csv' AS source_file,
       'A' AS dialect,
       CAST(l_shipdate AS DATE) AS date,
       '' AS time,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
       s_name AS merchant,
       p_name AS description,
       CASE WHEN l_linestatus = 'F' THEN 'Posted' ELSE 'Pending' END AS status,
       CASE WHEN l_returnflag = 'R' THEN 'Refund' ELSE 'Purchase' END AS type,
       p_type AS category
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
"""


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEED_E: events as a timestamped spending stream."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("account_id"),
        F.col("event_id").alias("txn_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("ts").cast("date").alias("date"),
        F.col("value").cast(AMOUNT_TYPE).alias("amount"),
        F.col("event_type").alias("category"),
    )


FEED_E_SQL = """
SELECT CAST(user_id AS VARCHAR) AS account_id,
       event_id AS txn_id,
       CAST(ts AS TIMESTAMP) AS ts,
       CAST(ts AS DATE) AS date,
       CAST(value AS DECIMAL(18,2)) AS amount,
       event_type AS category
FROM events
"""
