"""Behaviour cases (FIXTURES.md §5) for filters, aggregates and insights,
single-session (keys=()) and keyed."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as agg
from ledgerlens.operators import explore as ex
from ledgerlens.operators import insights as ins
from ledgerlens.operators import prepare as prep
from ledgerlens.sources import sinks


def test_posted_purchase_filter(spark):
    df = spark.createDataFrame(
        [("Posted", "Purchase", Decimal("5")), ("Pending", "Purchase", Decimal("5")),
         ("Posted", "Payment", Decimal("5")), ("Posted", "Purchase", Decimal("0")),
         ("Posted", "Purchase", Decimal("-3")), ("Posted", "Purchase", None)],
        "status string, type string, amount decimal(18,2)")
    assert prep.posted_purchases(df).count() == 1


def test_bad_date_counts_in_totals_not_in_months(spark, txns):
    df = txns([("a", 1, "2024-01-05", 10, "M", "", "C"), ("a", 2, None, 5, "M", "", "C")])
    assert agg.metrics(df).first().total == 15.0
    assert agg.monthly_totals(df).count() == 1
    prof = agg.weekday_profile(df).collect()
    assert sum(r["count"] for r in prof) == 1


def test_merge_keeps_duplicates(spark, txns):
    df = txns([("a", 1, "2024-01-05", 10, "M", "", "C")])
    assert prep.merge_exports(df, df).count() == 2


def test_weekday_only_friday(spark, txns):
    df = txns([("a", 1, "2024-01-05", 10, "M", "", "C")])  # a Friday
    prof = agg.weekday_profile(df).collect()
    assert [r.day for r in prof] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert [r.amount for r in prof] == [0, 0, 0, 0, 10.0, 0, 0]
    assert agg.peak_weekday(df).first().peak_day == "Fri"


def test_weekday_empty_gives_seven_zero_rows_and_monday(spark, txns):
    df = txns([("a", 1, "2024-01-05", 10, "M", "", "C")]).filter("false")
    assert agg.weekday_profile(df).count() == 7
    assert agg.peak_weekday(df).first().peak_day == "Mon"


def test_month_over_month(spark, txns):
    gap = txns([("a", 1, "2024-01-10", 100, "M", "", "C"), ("a", 2, "2024-03-10", 150, "M", "", "C")])
    r = ins.month_over_month(gap).first()
    assert (r.prev_label, r.curr_label, r.direction, r.pct) == ("Jan 2024", "Mar 2024", "up", 50.0)
    same = txns([("a", 1, "2024-01-10", 100, "M", "", "C"), ("a", 2, "2024-02-10", 100, "M", "", "C")])
    r = ins.month_over_month(same).first()
    assert (r.direction, r.pct, r.card_type) == ("down", 0.0, "mom_down")
    one = txns([("a", 1, "2024-01-10", 100, "M", "", "C")])
    assert ins.month_over_month(one).count() == 0


def test_recurring_rules(spark, txns):
    rows = []
    for i, amt in enumerate([9.99, 9.99, 9.99]):
        rows.append(("a", i, f"2024-01-0{i + 1}", amt, "Spotify", "", "C"))
    for i, amt in enumerate([5, 500, 5]):
        rows.append(("a", 10 + i, f"2024-01-0{i + 1}", amt, "TwoValues", "", "C"))
    for i, amt in enumerate([10, 20, 60]):
        rows.append(("a", 20 + i, f"2024-01-0{i + 1}", amt, "Varied", "", "C"))
    rows += [("a", 30, "2024-01-01", 7, "Twice", "", "C"), ("a", 31, "2024-01-02", 7.5, "Twice", "", "C")]
    df = txns(rows)
    strict = {r.name for r in ins.recurring(df).collect()}
    assert strict == {"Spotify", "TwoValues"}
    loose = {r.name: r for r in ins.recurring(df, min_count=2, ddof=1).collect()}
    assert set(loose) == {"Spotify", "TwoValues", "Twice"}
    assert loose["Twice"].latest_amount == 7.5
    tot = ins.recurring_total(df).first()
    assert tot.recurring_count == 2 and abs(tot.grand_total - (29.97 + 510)) < 1e-9


def test_merchant_stats_match_pandas(spark, txns):
    import pandas as pd
    amts = [12.5, 13.0, 12.75, 40.0, 12.5]
    df = txns([("a", i, "2024-01-01", a, "M", "", "C") for i, a in enumerate(amts)])
    r = ins.merchant_stats(df).first()
    s = pd.Series(amts)
    assert abs(r.std_pop - s.std(ddof=0)) < 1e-9 and abs(r.std_samp - s.std(ddof=1)) < 1e-9
    assert r.distinct_amounts == 4 and r["count"] == 5


def test_daily_average(spark, txns):
    one_day = txns([("a", 1, "2024-01-01", 30, "M", "", "C"), ("a", 2, "2024-01-01", 70, "M", "", "C")])
    assert agg.daily_average(one_day).first().daily_average == 100.0
    span = txns([("a", 1, "2024-01-01", 30, "M", "", "C"), ("a", 2, "2024-01-11", 70, "M", "", "C")])
    assert agg.daily_average(span).first().daily_average == 10.0


def test_largest_and_busiest_tie_breaks(spark, txns):
    df = txns([("a", 5, "2024-01-01", 50, "Old", "", "C"), ("a", 7, "2024-01-03", 50, "New", "", "C"),
               ("a", 6, "2024-01-03", 50, "NewLowId", "", "C"), ("a", 8, "2024-01-02", 10, "X", "", "C")])
    r = ins.largest_purchase(df).first()
    assert (r.merchant, r.date_label) == ("NewLowId", "Jan 03, 2024")
    keyed = ins.largest_purchase(df, ["account_id"]).first()
    assert (keyed.merchant, keyed.date_label) == ("NewLowId", "Jan 03, 2024")
    plan = ins.largest_purchase(df)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "SortAggregate" not in plan
    assert str(agg.busiest_day(df).first().date) == "2024-01-03"


def test_search_and_filters(spark, txns):
    df = txns([("a", 1, "2024-01-01", 1, "abc", "", "Travel"), ("a", 2, "2024-01-01", 1, "a.c", "", "Shopping")])
    assert ex.search(df, "a.c").count() == 1
    assert ex.search(df, "A.C", regex=True).count() == 2
    assert ex.filter_categories(df, []).count() == 2
    assert ex.filter_categories(df, ["Travel"]).count() == 1
    summary = agg.filter_summary(df, F.col("category") == "Travel").first()
    assert (summary.filtered_count, summary.total_count, summary.filtered_total) == (1, 2, 1.0)


def test_paging(spark, txns):
    empty = txns([("a", 1, "2024-01-01", 1, "m", "", "C")]).filter("false")
    assert ex.page_count(empty).first().pages == 1
    rows = [("a", i, f"2024-01-{1 + i % 28:02d}", i, f"m{i}", "", "C") for i in range(60)]
    df = txns(rows)
    pages = [{r.txn_id for r in ex.page(df, n).collect()} for n in (1, 2, 3)]
    assert [len(p) for p in pages] == [25, 25, 10]
    assert set().union(*pages) == set(range(60))
    assert ex.page_count(df).first().pages == 3
    first = ex.page(df, 1).collect()
    after = ex.page_after(df, {"date": first[-1].date, "txn_id": first[-1].txn_id}).collect()
    assert [r.txn_id for r in after] == [r.txn_id for r in ex.page(df, 2).collect()]


def test_sort_toggle():
    assert ex.toggle_sort("date", "desc", "date") == ("date", "asc")
    assert ex.toggle_sort("date", "desc", "amount") == ("amount", "desc")
    assert ex.toggle_sort("amount", "desc", "merchant") == ("merchant", "asc")


def test_export_quoting(spark, txns, tmp_path):
    df = txns([("a", 1, "2024-01-01", 3.5, 'Joe "X"', "d,e", "Travel")])
    line = sinks.export_lines(df).first().line
    assert line == '2024-01-01,"Joe ""X""","d,e",3.50,Travel'
    out = str(tmp_path / "export")
    sinks.export_csv(df, out)
    text = "".join(p.read_text() for p in sorted((tmp_path / "export").glob("part-*")))
    assert text.splitlines() == [sinks.EXPORT_HEADER, line]


def test_preview(spark, txns):
    rows = [("a", i, f"2024-01-{1 + i:02d}", 1, "M", "M" if i < 10 else "d", "C") for i in range(20)]
    df = txns(rows)
    shown = prep.preview_rows(df, 12).collect()
    assert [r.txn_id for r in shown] == list(range(19, 7, -1))
    p = prep.preview(df).first()
    assert (p.transaction_count, p.merchant_count, p.hidden_rows, p.shows_description) == (20, 1, 8, True)


def test_keyed_equals_unkeyed(spark):
    from ledgerlens.sources.feeds import feed_orders
    o = prep.posted_purchases(feed_orders(spark, "/root/testdata/sf0.001"))
    acct = o.select("account_id").orderBy("account_id").first().account_id
    one = o.filter(F.col("account_id") == acct)
    for fn in (agg.metrics, agg.peak_weekday, ins.largest_purchase, agg.daily_average):
        keyed = fn(o, ["account_id"]).filter(F.col("account_id") == acct).drop("account_id").collect()
        assert keyed == fn(one).collect(), fn.__name__


def test_invariants_sf001(spark):
    from ledgerlens.sources.feeds import feed_lineitem
    p = prep.posted_purchases(feed_lineitem(spark, "/root/testdata/sf0.01"))
    total = agg.metrics(p).first()
    cats = agg.category_totals(p).collect()
    assert abs(sum(r.amount for r in cats) - total.total) < 1e-6
    assert sum(r["count"] for r in cats) == total["count"] == 19927
    assert abs(sum(r.pct for r in agg.category_share(p).collect()) - 100) < 1e-9
    assert sum(r["count"] for r in agg.weekday_profile(p).collect()) == total["count"]


def test_bar_order_and_month_start(spark, txns):
    from ledgerlens.functions import formatting as fmt
    df = txns([("a", 1, "2024-03-15", 5, "M", "", "B"), ("a", 2, "2024-03-16", 9, "M", "", "A")])
    assert [r.category for r in agg.category_totals(df, ascending=True).collect()] == ["B", "A"]
    assert [r.category for r in agg.category_totals(df).collect()] == ["A", "B"]
    assert str(df.select(fmt.month_start("date")).first()[0]) == "2024-03-01"
    assert df.select(fmt.fmt_compact(F.lit(2500.0)), fmt.fmt_compact(F.lit(1250000.0)),
                     fmt.fmt_compact(F.lit(999.5)), fmt.fmt_currency(F.lit(-1234.5))).first() == \
        ("$2k", "$1.2M", "$1,000", "-$1,234.50")


def test_monthly_wide_discovers_columns_in_one_read(spark, txns):
    df = txns([("a", 1, "2024-01-05", 10, "M", "", "B"), ("a", 2, "2024-01-09", 5, "M", "", "A"),
               ("a", 3, "2024-02-01", 7, "M", "", None), ("a", 4, None, 9, "M", "", "C")])
    wide = agg.monthly_wide(df)
    assert wide.columns == ["month", "A", "B", "null"]
    got = {r.month: (r.A, r.B, r["null"]) for r in wide.collect()}
    assert got == {"2024-01": (5.0, 10.0, 0.0), "2024-02": (0.0, 0.0, 7.0)}
    keyed = agg.monthly_wide(df, ["A", "B"], keys=["account_id"])
    assert keyed.columns == ["account_id", "month", "A", "B"]
    empty = df.filter("false")
    assert agg.monthly_wide(empty).columns == ["month"] and agg.monthly_wide(empty).count() == 0
    assert agg.monthly_wide(df, []).count() == 2


def test_dashboard_over_an_empty_set(spark, txns):
    from ledgerlens.plans.report import dashboard
    empty = txns([("a", 1, "2024-01-05", 10, "M", "", "C")]).filter("false")
    board = dashboard(empty, persist=False)
    assert board["monthly_series"].count() == 0 and board["metrics"].count() == 1
    assert board["insights"]["day_of_week"].count() == 7
    keyed = dashboard(empty, ["account_id"], persist=False)
    assert all(v.count() == 0 for v in keyed["insights"].values())
