"""Dialect detection, CSV reading, normalisation, coercion."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.parsing import parse_amount, parse_date
from ledgerlens.sources import exports


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_detect_dialect():
    assert exports.detect_dialect(["Transaction Date", "Posted Date", "Debit", "Status", "Type", "Merchant"]) == "capital_one"
    assert exports.detect_dialect(["Date", "Status", "Type", "Merchant", "Amount"]) == "robinhood"
    with pytest.raises(ValueError):
        exports.detect_dialect(["Date", "Amount"])


def test_parse_date_and_amount(spark):
    df = spark.createDataFrame(
        [("2024-01-05", "12.50"), ("2024-1-5", "1e2"), ("bad", "abc"), ("2024-01-05 10:00", "nan"),
         ("01/05/2024", ""), (" 2024-01-05", " 3 ")], "d string, a string")
    rows = df.select(parse_date("d").alias("d"), parse_amount("a").alias("a"),
                     parse_amount("a", default=0).alias("z")).collect()
    assert [r.d for r in rows] == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), None, None, None, None]
    assert [r.a for r in rows] == [Decimal("12.50"), Decimal("100.00"), None, None, None, Decimal("3.00")]
    assert rows[2].z == Decimal("0.00")


def test_read_mixed_folder(spark, tmp_path):
    a = tmp_path / "acct=alice"
    a.mkdir()
    _write(a / "rh.csv",
           "Date,Time,Amount,Merchant,Description,Status,Type\n"
           '2024-01-05,10:00,12.50,Joe,"SQ *Joe Cafe, ""best"" HOUSTON TX",Posted,Purchase\n'
           "2024-01-06,,3.00,Pending Shop,,Pending,Purchase\n"
           "bad,,5.00,Bad Date,,Posted,Purchase\n")
    _write(a / "rh_min.CSV", "Merchant,Type,Status,Date,Amount\nShop,Purchase,Posted,2024-02-01,7\n")
    _write(a / "cap.csv",
           "Transaction Date,Posted Date,Card No.,Description,Category,Debit,Credit\n"
           "2024-01-07,2024-01-08,1234,SQ *Corner Bar,Dining,20.00,\n"
           "2024-01-09,2024-01-10,1234,CAPITAL ONE AUTOPAY,Payment/Credit,,100.00\n")
    _write(a / "notes.txt", "not,a,csv\n")
    df = exports.read_exports(spark, str(tmp_path / "*"), account_pattern=r"acct=([^/]+)")
    rows = {r.merchant: r for r in df.collect()}
    assert len(rows) == 6
    assert rows["Joe"].description == 'SQ *Joe Cafe, "best" HOUSTON TX'
    assert rows["Joe"].account_id == "alice"
    assert rows["Shop"].description == "" and rows["Shop"].time == ""
    assert rows["Bad Date"].date is None
    assert rows["Corner Bar"].type == "Purchase" and rows["Corner Bar"].amount == Decimal("20.00")
    assert rows["CAPITAL ONE AUTOPAY"].type == "Payment" and rows["CAPITAL ONE AUTOPAY"].amount == 0
    assert {r.dialect for r in rows.values()} == {"A", "B"}
    assert df.select("txn_id").distinct().count() == 6


def test_unknown_header_raises(spark, tmp_path):
    _write(tmp_path / "x.csv", "foo,bar\n1,2\n")
    with pytest.raises(ValueError):
        exports.read_exports(spark, str(tmp_path))


def test_both_dialect_headers_pick_b(spark, tmp_path):
    _write(tmp_path / "x.csv", "Transaction Date,Posted Date,Debit,Status,Type,Merchant,Description,Category\n"
           "2024-01-07,2024-01-08,5,Posted,Purchase,M,SQ *Deli,Food\n")
    sniffed = exports.sniff_dialects(spark, str(tmp_path)).collect()
    assert sniffed[0].dialect == "capital_one"
    assert exports.read_exports(spark, str(tmp_path)).first().merchant == "Deli"


def test_normalize_b_amount_rules(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "x", "SQ *Joe's", "Dining", ""), ("2024-01-01", "x", "SQ *AB", "Dining", "4.5")],
        "`Transaction Date` string, `Posted Date` string, Description string, Category string, Debit string")
    out = exports.normalize_b(df).collect()
    assert (out[0].merchant, out[0].type, out[0].status) == ("Joe's", "Payment", "Posted")
    assert (out[1].merchant, out[1].type) == ("SQ *AB", "Purchase")
    assert F is not None


def test_single_layout_fast_path(spark, tmp_path):
    head = "Date,Amount,Merchant,Description,Status,Type\n"
    _write(tmp_path / "a.csv", head + "2024-01-05,12.50,Joe,SQ *Joe Cafe,Posted,Purchase\n")
    _write(tmp_path / "b.csv", head + "2024-01-06,3.00,Ann,,Posted,Purchase\n")
    df = exports.read_exports(spark, str(tmp_path), single_layout=True)
    assert sorted(r.merchant for r in df.collect()) == ["Ann", "Joe"]
    _write(tmp_path / "c.csv", "Date,Merchant,Amount,Description,Status,Type\n2024-01-07,Bob,1,,Posted,Purchase\n")
    with pytest.raises(Exception):
        exports.read_exports(spark, str(tmp_path), single_layout=True).collect()


def test_empty_loads_are_refused_and_records_are_written(spark, tmp_path, txns):
    from ledgerlens.functions.formatting import day_span
    from ledgerlens.operators.prepare import require_nonempty
    from ledgerlens.sources.sinks import write_records

    df = txns([("x", 1, "2024-01-05", 1.5, "m", "d", "Travel"), ("x", 2, None, 2, "m", None, "c")])
    assert require_nonempty(df) is df
    with pytest.raises(ValueError, match="holds no row"):
        require_nonempty(df.limit(0))
    write_records(df, str(tmp_path / "records"), include_category=True)
    rows = {(r.date, r.merchant, r.amount, r.category) for r in spark.read.json(str(tmp_path / "records")).collect()}
    assert rows == {("2024-01-05", "m", 1.5, "Travel"), (None, "m", 2.0, "c")}
    assert spark.sql("SELECT DATE'2024-01-01' a, DATE'2024-03-01' b").select(day_span("a", "b")).first()[0] == 60
