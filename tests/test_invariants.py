"""Whole-table invariants at sf0.01."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.cleaning import clean_description
from ledgerlens.operators import classify as cls
from ledgerlens.operators import prepare as prep
from ledgerlens.sources.feeds import feed_lineitem, feed_orders
from tests.conftest import SF01

pytestmark = pytest.mark.skipif(not os.path.isdir(SF01), reason="sf0.01 tables not present")


def test_cleaning_never_empty_when_merchant_is_not(spark):
    for feed in (feed_orders, feed_lineitem):
        df = feed(spark, SF01).select(
            "merchant", clean_description("merchant", "description").alias("parsed"))
        bad = df.filter((F.col("merchant") != "") & ((F.col("parsed") == "") | F.col("parsed").isNull()))
        assert bad.count() == 0, feed.__name__


def test_categorize_keeps_rows_on_every_path(spark):
    prepared = prep.prepare(feed_orders(spark, SF01)).drop("category")
    n = prepared.count()
    rules = cls.categorize(prepared)
    cache = cls.categorize(prepared.filter(F.col("account_id") < "50")).select(
        "merchant", "parsed_description", "category").distinct()
    cached = cls.categorize(prepared, cache=cache)
    salted = cls.categorize(prepared, cache=cache, hot_rows=5, broadcast_rows=0)
    for out in (rules, cached, salted):
        assert out.count() == n
    # Rule categories do not depend on the path taken.
    by_txn = lambda df: {r.txn_id: r.category for r in df.select("txn_id", "category").collect()}
    assert by_txn(rules) == by_txn(cached) == by_txn(salted)


def test_merge_count_is_sum_of_counts(spark):
    o = feed_orders(spark, SF01)
    a = o.filter(F.col("source_file") <= "export_3.csv")
    b = o.filter(F.col("source_file") >= "export_2.csv")
    assert prep.merge_exports(a, b).count() == a.count() + b.count()
    assert prep.exclude_sources(o, spark.createDataFrame([("export_5.csv",)], "source_file string")).count() \
        == o.filter(F.col("source_file") != "export_5.csv").count()
