"""Salted joins give the same rows as plain joins and spread a hot key."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.classify import attach_categories
from ledgerlens.operators.insights import frequent_merchant_rows
from ledgerlens.operators.skew import BUCKETS, SALT, _with_buckets, balanced_join, hot_keys, salted_join


@pytest.fixture
def skewed(spark):
    # Two thirds of the rows share one pair; some descriptions are NULL.
    rows = [(i, "HOT" if i % 3 else f"m{i % 7}", None if i % 11 == 0 else "d") for i in range(600)]
    return spark.createDataFrame(rows, "txn_id long, merchant string, parsed_description string")


def _counts(df, on):
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("count")).checkpoint()


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_salted_attach_equals_plain(spark, skewed):
    mapping = spark.createDataFrame(
        [("HOT", "d", "X"), ("m1", "d", "Y"), ("HOT", None, "Z")],
        "merchant string, parsed_description string, category string")
    counts = _counts(skewed, ["merchant", "parsed_description"])
    plain = attach_categories(skewed, mapping)
    salted = attach_categories(skewed, mapping, counts, hot_rows=10, broadcast_rows=0)
    broadcast = attach_categories(skewed, mapping, counts, hot_rows=10)
    assert _rows(salted) == _rows(plain) == _rows(broadcast)
    assert salted.count() == skewed.count()
    plan = broadcast._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("how", ["left_semi", "left_anti", "inner"])
def test_salted_join_kinds_equal_plain(spark, skewed, how):
    on = ["merchant"]
    counts = _counts(skewed, on)
    right = counts.filter(F.col("count") >= 60).select("merchant", F.lit(1).alias("flag"))
    plain = salted_join(skewed, right, on, how, counts, ["txn_id"], hot_rows=10 ** 9)
    salted = salted_join(skewed, right, on, how, counts, ["txn_id"], hot_rows=25)
    assert _rows(salted) == _rows(plain)


def test_hot_key_rows_spread_over_buckets(spark, skewed):
    on = ["merchant"]
    counts = _counts(skewed, on)
    hot = hot_keys(counts, on, hot_rows=50)
    assert {r.merchant: r[BUCKETS] for r in hot.collect()} == {"HOT": 8}
    salted = _with_buckets(skewed, hot, on).withColumn(
        SALT, F.pmod(F.xxhash64("txn_id"), F.col(BUCKETS)))
    per_bucket = [r["count"] for r in salted.filter("merchant = 'HOT'").groupBy(SALT).count().collect()]
    assert len(per_bucket) == 8 and max(per_bucket) < 100


@pytest.mark.parametrize("how", ["left_semi", "left_anti", "left"])
def test_broadcast_branch_equals_salted(spark, skewed, how):
    on = ["merchant"]
    counts = _counts(skewed, on)
    right = counts.filter(F.col("count") >= 60).select("merchant", F.lit(1).alias("flag"))
    small = balanced_join(skewed, right, on, how, counts, ["txn_id"], hot_rows=25)
    big = balanced_join(skewed, right, on, how, counts, ["txn_id"], hot_rows=25, broadcast_rows=0)
    assert _rows(small) == _rows(big)


def test_more_hot_keys_than_the_bound_are_spread_coarser(spark, skewed):
    counts = _counts(skewed, ["txn_id"])
    out = salted_join(skewed, skewed.select("txn_id"), ["txn_id"], "left_semi", counts,
                      ["txn_id"], hot_rows=0, max_hot_keys=10)
    assert out.count() == skewed.count()


def test_frequent_rows_salted_equals_plain(spark, skewed):
    plain = frequent_merchant_rows(skewed, 90, (), "merchant", hot_rows=10 ** 9, broadcast_rows=0)
    salted = frequent_merchant_rows(skewed, 90, (), "merchant", hot_rows=30, broadcast_rows=0)
    assert _rows(salted) == _rows(plain)
    assert {r.merchant for r in plain.collect()} == {"HOT"}
