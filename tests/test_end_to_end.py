"""The whole user flow as the README shows it: exports in a folder → preview
→ categorise (cache + rules) → dashboard → table view → CSV export."""

from ledgerlens.operators import explore as ex
from ledgerlens.operators.classify import categorize
from ledgerlens.operators.prepare import prepare, preview
from ledgerlens.plans.report import dashboard
from ledgerlens.sources.cache import load_cache, versions
from ledgerlens.sources.exports import read_exports
from ledgerlens.sources.sinks import export_csv


def _write(path, text):
    path.write_text(text)


def test_user_flow(spark, tmp_path):
    for acct in ("alice", "bob"):
        d = tmp_path / "exports" / f"acct={acct}"
        d.mkdir(parents=True)
        _write(d / "card.csv",
               "Date,Time,Amount,Merchant,Description,Status,Type\n"
               "2024-01-05,,9.99,Spotify,Spotify P3DCEA9B48,Posted,Purchase\n"
               "2024-02-05,,9.99,Spotify,Spotify P3DCEA9B48,Posted,Purchase\n"
               "2024-03-05,,9.99,Spotify,Spotify P3DCEA9B48,Posted,Purchase\n"
               "2024-03-09,,42.00,Uber,UBER *TRIP HOUSTON TX,Posted,Purchase\n"
               "2024-03-10,,5.00,Cafe,SQ *Blue Bottle Coffee,Pending,Purchase\n")
    cache_root = str(tmp_path / "category-cache")

    raw = read_exports(spark, str(tmp_path / "exports" / "*"), account_pattern=r"acct=([^/]+)")
    prepared = prepare(raw)
    summary = {r.account_id: r for r in preview(prepared, keys=["account_id"]).collect()}
    assert summary["alice"].transaction_count == 4 and summary["bob"].merchant_count == 2

    categorised = categorize(prepared, cache=load_cache(spark, cache_root), cache_root=cache_root)
    assert versions(spark, cache_root) == [1]
    board = dashboard(categorised, keys=["account_id"])
    metrics = {r.account_id: r for r in board["metrics"].collect()}
    assert round(metrics["alice"].total, 2) == 71.97
    recurring = board["insights"]["recurring"].filter("account_id = 'bob'").collect()
    assert [(r.name, r["count"]) for r in recurring] == [("Spotify", 3)]

    rows = ex.page(ex.search(ex.filter_categories(categorised, ["Transport"]), "uber"), 1).collect()
    assert [r.merchant for r in rows] == ["Uber", "Uber"]

    export_csv(categorised, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    lines = text.splitlines()
    assert lines[0] == "Date,Merchant,Description,Amount,Category" and len(lines) == 9
