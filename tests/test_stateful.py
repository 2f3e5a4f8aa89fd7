"""R1–R4 with state: mixed folders, a live cache, closing months, late rows."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import classify as cls
from ledgerlens.sources import exports
from ledgerlens.streaming import stateful as st

EVENT = "ts timestamp, category string, amount decimal(18,2), txn_id long"


def _files(spark, folder, parts, schema):
    """One file per part, in order of time."""
    import os

    folder.mkdir()
    for k, rows in enumerate(parts):
        tmp = folder.parent / f"{folder.name}-{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp))
        source = next(tmp.glob("part-*.parquet"))
        target = folder / f"{k:03d}.parquet"
        target.write_bytes(source.read_bytes())
        os.utime(target, (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _done(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def _events(seed, late_share):
    rng = random.Random(seed)
    rows = [(dt.datetime(2024, 1, 1, 12) + dt.timedelta(hours=9 * k), rng.choice("abc"), Decimal(rng.randint(1, 900)) / 4, k) for k in range(400)]
    parts = [[] for _ in range(10)]
    for r in rows:
        k = min(9, r[3] // 40 + (rng.randint(2, 6) if rng.random() < late_share else 0))
        parts[k].append(r)
    return rows, parts


@pytest.mark.parametrize("late_share", [0.0, 0.2])
def test_months_close_and_leave_the_state(spark, tmp_path, late_share):
    rows, parts = _events(3, late_share)
    stream = _files(spark, tmp_path / "in", parts, EVENT)
    query = _done(st.start_closing_totals(stream, str(tmp_path / "out"), str(tmp_path / "chk")))
    got = {(r.month, r.category): (r.amount, r["count"], r.late_count, r.closed) for r in st.month_totals(spark, str(tmp_path / "out")).collect()}
    want = {}
    for ts, category, amount, _ in rows:
        total, n = want.get((ts.strftime("%Y-%m"), category), (0, 0))
        want[ts.strftime("%Y-%m"), category] = (total + amount, n + 1)
    assert {k: v[:2] for k, v in got.items()} == want
    assert (sum(v[2] for v in got.values()) > 0) == (late_share > 0)
    last = max(m for m, _ in want)
    assert {m for (m, _), v in got.items() if not v[3]} == {last}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len({m for m, _ in want}) == 5 and held and held[-1] <= 2 * 8  # one open month, not five


def test_late_rows_are_kept_in_a_ledger(spark, tmp_path):
    rows, parts = _events(5, 0.25)
    stream = _files(spark, tmp_path / "in", parts, EVENT)
    _done(st.start_daily_ledger(stream, str(tmp_path / "out"), str(tmp_path / "chk")))
    got = {r.window_start.date(): (r.amount, r["count"], r.late_amount, r.late_count) for r in st.daily_ledger(spark, str(tmp_path / "out")).collect()}
    want, watermark = {}, None
    for part in parts:
        for ts, _, amount, _ in part:
            late = watermark is not None and dt.datetime.combine(ts.date(), dt.time()) + dt.timedelta(days=1) <= watermark
            a, n, la, ln = want.get(ts.date(), (0, 0, 0, 0))
            want[ts.date()] = (a, n, la + amount, ln + 1) if late else (a + amount, n + 1, la, ln)
        newest = max(ts for ts, *_ in part) - dt.timedelta(days=1)
        watermark = newest if watermark is None else max(watermark, newest)
    assert got == want and sum(v[3] for v in want.values()) > 20
    assert sum(v[1] + v[3] for v in got.values()) == 400


@pytest.mark.parametrize("salts", [1, 4])
def test_live_cache_corrects_rows_that_waited(spark, tmp_path, salts):
    rng = random.Random(2)
    pairs = [(f"m{k}" if k else None, f"d{k}") for k in range(12)]
    rows = [[(*(pairs[0] if rng.random() < 0.3 else rng.choice(pairs)), 100 * f + k) for k in range(60)] for f in range(4)]
    labels = [[(*p, "early", 1) for p in pairs[:5]], [(*p, "late", 2) for p in pairs[5:10]], [(*pairs[0], "changed", 3)]]
    stream = _files(spark, tmp_path / "rows", rows, "merchant string, parsed_description string, txn_id long")
    changes = _files(spark, tmp_path / "labels", labels, "merchant string, parsed_description string, category string, version long")
    _done(st.start_live_categories(stream, changes, str(tmp_path / "out"), str(tmp_path / "chk"), salts=salts))
    got = {r.txn_id: r.category for r in st.latest_categories(spark, str(tmp_path / "out")).collect()}
    known = {p: "early" for p in pairs[:5]} | {p: "late" for p in pairs[5:10]}
    flat = {t: (m, d) for part in rows for m, d, t in part}
    assert set(got) == set(flat)
    for t, pair in flat.items():
        allowed = {"early", "changed"} if pair == pairs[0] else {known.get(pair, "Uncategorized")}
        assert got[t] in allowed
    log = spark.read.parquet(str(tmp_path / "out"))
    assert log.where("correction").count() > 0 and log.where("not correction").count() == 240


def test_mixed_folder_in_one_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('Date,Amount,Merchant,Description,Status,Type\n2024-01-05,1.00,m1,"two\nlines",Posted,Purchase\n2024-01-06,2.00,m2,d,Pending,Purchase\n')
    (folder / "b.csv").write_text("Type,Status,Merchant,Time,Amount,Date\nPurchase,Posted,m3,,3.00,2024-02-01\n")
    (folder / "c.CSV").write_text("Transaction Date,Posted Date,Card No.,Description,Category,Debit\n2024-01-02,2024-01-03,1,SQ *Shop,Misc,5.25\n")
    (folder / "x.csv").write_text("When,What\n2024,x\n")
    (folder / "y.csv").write_text("Status,Type,Merchant\nPosted,Purchase,m\n")
    (folder / "z.txt").write_text("not an export")
    sink = str(tmp_path / "out")
    _done(st.start_folder(spark, str(folder), sink, str(tmp_path / "chk"), max_files_per_trigger=2))
    rows = spark.read.parquet(f"{sink}/rows")
    assert {(r.source_file, r.merchant, float(r.amount), r.parsed_description) for r in rows.collect()} == {
        ("a.csv", "m1", 1.0, "two lines"), ("b.csv", "m3", 3.0, "m3"), ("c.CSV", "Shop", 5.25, "Shop")}
    assert sorted(r.header for r in spark.read.parquet(f"{sink}/quarantine").collect()) == ["Status,Type,Merchant", "When,What"]
    (folder / "x.csv").unlink()
    (folder / "y.csv").unlink()
    batch = exports.read_exports(spark, str(folder))
    assert sorted(r.txn_id for r in rows.collect()) == sorted(r.txn_id for r in batch.where("status = 'Posted'").collect())
