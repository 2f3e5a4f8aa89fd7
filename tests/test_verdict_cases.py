"""Cases that earlier rounds got wrong."""

import datetime as dt
import json
from decimal import Decimal

import pytest

from ledgerlens.operators import aggregates as agg
from ledgerlens.operators import classify as cls
from ledgerlens.operators import explore as ex
from ledgerlens.operators import insights as ins
from ledgerlens.operators import skew
from ledgerlens.plans.report import dashboard
from ledgerlens.session import scratch_path
from ledgerlens.sources import cache, exports


def test_last_echo_wins_and_missing_fields_are_blank(spark):
    batched = spark.createDataFrame([(0, 1, "Uber", "trip"), (0, 2, "Shop", ""), (0, 3, "Cafe", None), (0, 4, None, "fee"), (0, 5, "Gone", "x")],
                                    "batch_id long, position int, merchant string, parsed_description string")
    reply = {"results": [{"merchant": "Uber", "description": "trip", "category": "Travel"}, {"merchant": "Uber", "description": "trip", "category": "Shopping"},
                         {"merchant": "Shop", "category": "Travel"}, {"merchant": "Cafe", "category": "Dining & Drinks"}, {"description": "fee", "category": "Financial"}]}
    replies = spark.createDataFrame([(0, json.dumps(reply))], "batch_id long, reply string")
    got = {r.position: (r.category, r.answered) for r in cls.parse_replies(replies, batched).collect()}
    assert got == {1: ("Shopping", True), 2: ("Travel", True), 3: ("Dining & Drinks", True), 4: ("Financial", True), 5: ("Uncategorized", False)}


def test_permanent_classifier_error_stops_the_run(spark):
    def rejected(prompt):
        raise cls.PermanentClassifierError("key rejected")

    def down(prompt):
        raise ConnectionError

    with pytest.raises(cls.PermanentClassifierError):
        cls._call_with_retry(rejected, "p", [], 1, 1, 0)
    assert cls._call_with_retry(down, "p", [], 1, 1, 0) is None
    replies = spark.createDataFrame([(0, None), (1, "{}")], "batch_id long, reply string")
    assert tuple(cls.failed_batches(replies).first()) == (1, 2)


def test_large_rule_table(spark):
    rules = spark.range(12_000).selectExpr("id AS priority", "concat('word', id, '$') AS pattern", "IF(id < 11999, 'Travel', 'Health') AS category")
    found = cls.rules_from_table(rules)
    assert [r.category for r in found] == ["Travel", "Health"]
    df = spark.createDataFrame([("a word77",), ("word11999",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(cls.rule_category(df.t, found)).collect()] == ["Travel", "Health", "Uncategorized"]


def test_more_categories_than_the_pivot_limit(spark, txns):
    df = txns([("x", i, "2024-01-05", 1, "m", "d", f"c{i}") for i in range(6)])
    kept = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        assert len(agg.monthly_wide(df).columns) == 7
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", kept)


def test_more_hot_keys_than_the_broadcast_holds(spark):
    left = spark.range(400).selectExpr("id % 40 AS k", "id AS txn_id")
    right = spark.range(40).selectExpr("id AS k", "id * 10 AS v")
    out = skew.salted_join(left, right, ["k"], "inner", left.groupBy("k").count(), ["txn_id"], hot_rows=2, max_hot_keys=5)
    assert out.count() == 400 and out.where("v <> k * 10").count() == 0


def test_corrupt_cache_version_falls_back(spark, tmp_path):
    root = str(tmp_path / "cache")
    pairs = lambda c: spark.createDataFrame([("m", "d", c)], "merchant string, parsed_description string, category string")
    cache.upsert_cache(spark, root, pairs("Travel"))
    cache.upsert_cache(spark, root, pairs("Shopping"))
    assert cache.load_cache(spark, root).first().category == "Shopping"
    for f in (tmp_path / "cache" / "v=2").glob("*.parquet"):
        f.write_bytes(b"not parquet")
    for f in (tmp_path / "cache" / "v=2").glob(".*.crc"):
        f.write_bytes(b"")
    with pytest.warns(UserWarning):
        assert cache.load_cache(spark, root).first().category == "Travel"
    with pytest.warns(UserWarning):
        assert cache.upsert_cache(spark, root, pairs("Health")) == 3
    assert cache.load_cache(spark, root).first().category == "Health"


@pytest.mark.parametrize("column, direction, locale", [("date", "desc", False), ("date", "asc", False), ("merchant", "asc", True), ("amount", "desc", False)])
def test_keyset_pages_cover_every_row_once(spark, column, direction, locale):
    rows = [(i if i not in (5, 6) else 4, None if i % 4 == 3 else dt.date(2024, 1, 1 + i % 6), None if i % 5 == 0 else Decimal(i % 7), "bBaA"[i % 4], "c") for i in range(23)]
    rows[5] = rows[6] = rows[4]  # equal rows, equal ids
    df = spark.createDataFrame(rows, "txn_id long, date date, amount decimal(18,2), merchant string, category string")
    want = [tuple(r) for r in ex.sort_transactions(df, column, direction, locale).collect()]
    got, shown = [tuple(r) for r in ex.page(df, 1, column, direction, 4, locale).collect()], 0
    at = ("txn_id", "date", "amount", "merchant", "category").index(column)
    for _ in range(10):
        last = got[-1]
        shown = sum(r[0] == last[0] and r[at] == last[at] for r in got)
        more = [tuple(r) for r in ex.page_after(df, {"txn_id": last[0], column: last[at]}, column, direction, 4, locale, shown).collect()]
        if not more:
            break
        got += more
    assert got == want


def test_row_ids_do_not_depend_on_file_packing(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.csv").write_text("Date,Time,Amount,Merchant,Description,Status,Type\n" + "".join(f"2024-01-05,,{i}.00,m{k},d,Posted,Purchase\n" for i in range(30)))
    kept = spark.conf.get("spark.sql.files.openCostInBytes")
    ids = []
    for cost in ("1", "100000000"):
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        ids.append(sorted((r.merchant, r.amount, r.txn_id) for r in exports.read_exports(spark, str(tmp_path)).collect()))
    spark.conf.set("spark.sql.files.openCostInBytes", kept)
    assert ids[0] == ids[1] and len({x[2] for x in ids[0]}) == 180


def test_merchant_statistics_without_unknown_amounts(txns):
    df = txns([("x", i, "2024-01-05", a, "m", "d", "c") for i, a in enumerate([5, 5, None, 7])])
    r = ins.merchant_stats(df).first()
    assert r["avg"] == pytest.approx(17 / 3) and r.distinct_amounts == 2 and r.std_samp == pytest.approx(1.1547005)


def test_deviations_agree_with_the_built_in_ones(spark, txns):
    from pyspark.sql import functions as F

    df = txns([("x", i, "2024-01-05", Decimal(100 + i * i % 17), f"m{i % 4}", "d", "c") for i in range(60)])
    want = {r["merchant"]: r for r in df.groupBy("merchant").agg(F.stddev_pop("amount").alias("p"), F.stddev_samp("amount").alias("s")).collect()}
    for r in ins.merchant_stats(df).collect():
        assert r["std_pop"] == pytest.approx(want[r["name"]].p) and r["std_samp"] == pytest.approx(want[r["name"]].s)


def test_text_sorts_as_in_the_browser_by_default(spark):
    df = spark.createDataFrame([(1, "B"), (2, "a"), (3, "b"), (4, "A")], "txn_id long, merchant string")
    assert [r.merchant for r in ex.sort_transactions(df, "merchant").collect()] == ["a", "A", "b", "B"]
    assert [r.merchant for r in ex.sort_transactions(df, "merchant", locale=False).collect()] == ["A", "B", "a", "b"]


def test_lookup_side_is_bounded_by_bytes(spark):
    wide = spark.range(10).selectExpr("id AS k", "repeat('x', 1000) AS t")
    assert skew.small_enough(wide, 10, 20_000) and not skew.small_enough(wide, 10, 9_000) and not skew.small_enough(wide, 9, 20_000)


def test_cached_label_goes_before_the_rules(spark, txns):
    df = txns([("x", 1, "2024-01-05", 1, "Shell", "shell oil", "c"), ("x", 2, "2024-01-05", 1, "Lyft", "lyft", "c")]).withColumnRenamed("description", "parsed_description")
    known = spark.createDataFrame([("Shell", "shell oil", "Travel")], "merchant string, parsed_description string, category string")
    for rows in (10, 0):  # broadcast, and the pairs' path
        got = cls.categorize(df, cache=known, broadcast_rows=rows)
        assert {r.txn_id: r.category for r in got.collect()} == {1: "Travel", 2: "Transport"}
    hits, misses = cls.cache_split(cls.distinct_pairs(df), known)
    assert [r.merchant for r in hits.collect()] == ["Shell"] and [r.merchant for r in misses.collect()] == ["Lyft"]


def test_dashboard_lists_newest_first_and_releases(spark, txns):
    df = txns([("x", i, f"2024-01-0{1 + (i * 2) % 5}", 1, "m", "d", "c") for i in range(5)])
    board = dashboard(df)
    dates = [r[0] for r in board["transactions"].collect()]
    assert dates == sorted(dates, reverse=True) or [r.date for r in board["transactions"].collect()] == sorted((r.date for r in board["transactions"].collect()), reverse=True)
    assert not board["release"]().is_cached


def test_one_pair_is_saved(spark):
    root = scratch_path(spark, "t-one")
    got = cls.categorize_one(spark, "Shell", "shell oil", cache_root=root).first().category
    assert got == "Transport" and cache.load_cache(spark, root).first().category == "Transport"
