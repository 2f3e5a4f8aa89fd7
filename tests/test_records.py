"""Records with quoted line breaks, one file read by many tasks."""

import csv
import io
import random

import pytest

from ledgerlens.sources import exports, records

WORDS = ["a", "", "x, y", 'say "hi"', "two\nlines", 'q"\n,"\n\nz', "plain text", " lead", "é–ü", ",", '"']


def _text(rows, header=("Date", "Time", "Amount", "Merchant", "Description", "Status", "Type", "Cardholder"), end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    yield lambda size: [spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)), spark.conf.set("spark.sql.files.openCostInBytes", "0")]
    for k, v in kept.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("size, end", [(1 << 27, "\n"), (4000, "\n"), (97, "\n"), (50, "\r\n"), (7, "\n")])
def test_records_do_not_depend_on_the_splits(spark, tmp_path, small_splits, size, end):
    rng = random.Random(size)
    want, lines = [], 40 if size > 10 else 8
    for f in range(3):
        rows = [(f"2024-01-{1 + k % 28:02d}", rng.choice(WORDS), f"{k}.50", rng.choice(WORDS), rng.choice(WORDS), "Posted", "Purchase", rng.choice(WORDS)) for k in range(lines)]
        (tmp_path / f"f{f}.csv").write_bytes((("﻿" if f == 1 else "") + _text(rows, end=end)).encode())
        want += [(f"f{f}.csv", *r[:1], r[1], r[2], r[3], r[4]) for r in rows]
    small_splits(size)
    got = exports.read_exports(spark, str(tmp_path))
    rows = sorted((r.source_file, str(r.date), r.time, str(r.amount), r.merchant, r.description) for r in got.collect())
    assert rows == sorted(want)
    if size == 97:
        found, _ = records.read_records(spark, str(tmp_path), exports.CSV_GLOB)
        assert records.text_lines(spark, str(tmp_path), exports.CSV_GLOB).select("file_path", "block").distinct().groupBy("file_path").count().agg({"count": "min"}).first()[0] > 10
        assert found.count() == len(want)


def test_rows_have_the_ids_of_the_csv_scan(spark, tmp_path):
    rows = [("2024-01-05", "", f"{k}.00", f"m{k}", "two\nlines" if k % 3 else "d", "Posted", "Purchase", 'J "D"') for k in range(30)]
    (tmp_path / "a.csv").write_text(_text(rows))
    scan = exports.read_exports(spark, str(tmp_path), single_layout=True)
    assert sorted(map(tuple, exports.read_exports(spark, str(tmp_path)).collect())) == sorted(map(tuple, scan.collect()))


def test_layouts_missing_cells_and_unknown_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Type,Status,Merchant,Amount,Date\nPurchase,Posted,m1,1.00,2024-01-01,extra,cells\nPurchase,Posted,m2\n\n   \nPurchase,Posted,m3,3,2024-01-03")
    (tmp_path / "B.CSV").write_text('"Transaction Date","Posted Date","Card No.",Description,Category,Debit\r\n2024-01-02,2024-01-03,"1,2\r\n3",SQ *Shop,Misc,5.25\r\n')
    (tmp_path / "empty.csv").write_text("")
    got = {r.merchant: (r.dialect, str(r.date), None if r.amount is None else float(r.amount), r.time) for r in exports.read_exports(spark, str(tmp_path)).collect()}
    assert got == {"m1": ("A", "2024-01-01", 1.0, ""), "m2": ("A", "None", None, ""), "m3": ("A", "2024-01-03", 3.0, ""), "Shop": ("B", "2024-01-02", 5.25, "")}
    (tmp_path / "odd.csv").write_text("When,What\n2024,x\n")
    with pytest.raises(ValueError, match="When"):
        exports.read_exports(spark, str(tmp_path))
    assert exports.read_exports(spark, str(tmp_path), unknown="skip").count() == 4
    assert [r.header for r in exports.unknown_exports(spark, str(tmp_path)).collect()] == ["When,What"]
    (tmp_path / "odd.csv").write_text("Status,Type,Merchant\nPosted,Purchase,m\n")
    with pytest.raises(ValueError, match="lacks"):
        exports.read_exports(spark, str(tmp_path))


def test_a_quote_that_never_ends_keeps_the_rest_as_one_record(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('Date,Amount,Merchant,Status,Type\n2024-01-01,1,m1,Posted,Purchase\n2024-01-02,2,"open,Posted\n' + "more\n" * 40)
    for size in (1 << 27, 60):
        small_splits(size)
        found, _ = records.read_records(spark, str(tmp_path), exports.CSV_GLOB)
        assert sorted(len(r.record.splitlines()) for r in found.collect()) == [1, 41]
