"""Numeric ranks used inside hash aggregates order rows exactly like the
struct orderings they stand for."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerlens.operators.ordering import newest_rank


def _rows(n=400, seed=7):
    rnd = random.Random(seed)
    edge_ids = [-(2 ** 63), 2 ** 63 - 1, 0, -1, 1]
    edge_days = [dt.date(1, 1, 1), dt.date(9999, 12, 31), dt.date(1970, 1, 1), None]
    rows = []
    for i in range(n):
        day = rnd.choice(edge_days) if i % 5 == 0 else dt.date(2024, 1, 1) + dt.timedelta(rnd.randint(0, 40))
        txn = rnd.choice(edge_ids) if i % 7 == 0 else rnd.randint(-(2 ** 63), 2 ** 63 - 1)
        rows.append((i, day, txn))
    return rows


def test_newest_rank_matches_struct_order(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id int, date date, txn_id long")
    got = [r.id for r in df.orderBy(newest_rank().desc(), "id").collect()]
    # Newest date first, a NULL date last, then the lower txn_id.
    want = [i for i, _, _ in sorted(
        rows, key=lambda r: (r[1] is not None, r[1] or dt.date.min, -r[2], -r[0]), reverse=True)]
    assert got == want


def test_latest_charge_is_hash_aggregated(spark):
    from ledgerlens.operators.insights import merchant_stats
    rows = [("a", 1, dt.date(2024, 1, 5), "9.99", "M"), ("a", 2, dt.date(2024, 1, 5), "5.00", "M"),
            ("a", 3, None, "7.00", "M"), ("b", 9, None, "1.00", "N")]
    df = spark.createDataFrame(rows, "account_id string, txn_id long, date date, amount string, merchant string") \
        .withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    out = merchant_stats(df, ["account_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    got = {r.account_id: r.latest_amount for r in out.collect()}
    # Same newest day: the lower txn_id is the latest; only NULL dates: lowest txn_id.
    assert got == {"a": 9.99, "b": 1.0}
