"""The maintained dashboard against the dashboard over the rows."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import rollups
from ledgerlens.plans.report import dashboard
from ledgerlens.plans.rollups import DashboardStore, merged, rollup

CATEGORIES = ["a", "b", "c"]


@pytest.fixture
def uploads(txns):
    def make(seed):
        return txns([(f"acct{k % 2}", 1000 * seed + k, f"2024-0{1 + (k + seed) % 4}-{1 + k % 28:02d}" if k % 9 else None, 10 + k * seed % 7, f"m{k % 5}" if k % 11 else None, "d", CATEGORIES[(k + seed) % 3]) for k in range(60)])
    return make


def flat(board):
    out = {}
    for name, df in {**board, **board["insights"]}.items():
        if name not in ("insights", "release"):
            out[name] = sorted((tuple(r) for r in df.collect()), key=str)
    return out


@pytest.mark.parametrize("keys", [[], ["account_id"]])
def test_results_equal_the_dashboard_over_the_rows(spark, tmp_path, uploads, keys):
    store = DashboardStore(spark, str(tmp_path / "store"), keys)
    for k in (1, 2, 3):
        store.add(f"u{k}", uploads(k))
    store.remove("u2")
    store.remove("never there")
    store.add("u3", uploads(5))   # in the place of the first u3
    store.add("u4", uploads(7))
    assert store.uploads() == ["u1", "u3", "u4"]
    left = uploads(1).unionByName(uploads(5)).unionByName(uploads(7))
    assert flat(store.dashboard(CATEGORIES)) == flat(dashboard(left, keys, CATEGORIES, persist=False))


def test_what_is_taken_out_leaves_nothing(spark, tmp_path, uploads):
    store = DashboardStore(spark, str(tmp_path / "store"))
    store.add("only", uploads(2))
    store.remove("only")
    assert store.grain("amount").count() == 0 and store.category_totals().count() == 0 and store.uploads() == []
    with pytest.raises(ValueError):
        store.dashboard(CATEGORIES)
    part = rollup(uploads(3))
    back = part.withColumns({"_sum": (-F.col("_sum")).cast("decimal(38,2)"), "_n": -F.col("_n")})
    assert merged(part.unionByName(back)).count() == 0


def test_summaries_read_no_rows(spark, tmp_path, uploads):
    store = DashboardStore(spark, str(tmp_path / "store"))
    store.add("u", uploads(1))
    plans = [store.category_totals(), store.monthly_series(CATEGORIES), store.metrics(), *store.insights().values()]
    assert all("/rows" not in df._jdf.queryExecution().optimizedPlan().toString() and not any("/rows/" in f for f in df.inputFiles()) for df in plans)


def test_two_writers_at_once(spark, tmp_path, uploads):
    root = str(tmp_path / "store")
    DashboardStore(spark, root).add("u0", uploads(1))
    frames = {k: uploads(k) for k in (2, 3)}
    threads = [threading.Thread(target=lambda k=k: DashboardStore(spark, root).add(f"u{k}", frames[k])) for k in frames]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = DashboardStore(spark, root)
    assert store.uploads() == ["u0", "u2", "u3"] and store.metrics().first()["count"] == 180


def test_a_change_does_not_write_the_store_anew(spark, tmp_path, txns):
    store = DashboardStore(spark, str(tmp_path / "store"))
    for k in range(8):
        store.add(f"u{k}", txns([("a", 10 * k + i, f"2024-01-{1 + i:02d}", 100 * k + i, f"m{k}", "d", f"c{k}") for i in range(9)]))
    own, again = (spark.read.parquet(str(tmp_path / "store" / at)).count() for at in ("uploads/*/rollup", "merged/*"))
    assert again <= 2 * own   # one merged rollup at every change: over four times as many
    assert store.metrics().first()["count"] == 72


def test_levels_and_tasks_add_up_alike(spark, tmp_path, txns, uploads, monkeypatch):
    """Many changes, parts that are merged without what they take from, and several tasks."""
    monkeypatch.setattr(rollups, "FOLD", 2)
    monkeypatch.setattr(rollups, "TASK_GRAINS", 50)
    store = DashboardStore(spark, str(tmp_path / "store"), ["account_id"])
    wrong = uploads(3).withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)"))
    for name, rows in (("u1", uploads(1)), ("u2", uploads(2)), ("u3", wrong), ("u3", uploads(3)), ("u1", None), ("u2", uploads(4)), ("u2", uploads(6)), ("u5", uploads(5)), ("u5", None)):
        store.add(name, rows) if rows is not None else store.remove(name)
        _, state = store._state()
        assert sum(p["uploads"] for p in state["parts"]) <= 2 * (len(state["uploads"]) + 2)
    assert store.uploads() == ["u2", "u3"]
    assert store._added_up(state["parts"]).rdd.getNumPartitions() > 1
    left = uploads(3).unionByName(uploads(6))
    assert flat(store.dashboard(CATEGORIES)) == flat(dashboard(left, ["account_id"], CATEGORIES, persist=False))


def test_a_store_with_one_merged_rollup_goes_on(spark, tmp_path, uploads):
    root = tmp_path / "store"
    store = DashboardStore(spark, str(root))
    for k in (1, 2):
        store.add(f"u{k}", uploads(k))
    _, state = store._state()
    store._added_up(state["parts"]).write.parquet(str(root / "merged" / "old"))
    (root / "log" / "000000009.json").write_text(json.dumps({"uploads": state["uploads"], "merged": "merged/old"}))
    store.remove("u1")
    assert store.metrics().first()["count"] == 60
    assert flat({"insights": store.insights()}) == flat({"insights": dashboard(uploads(2), [], CATEGORIES, persist=False)["insights"]})


def test_rows_are_dealt_before_they_are_rolled_up(spark, tmp_path, uploads, monkeypatch):
    """A task rolls up a bounded number of rows, and the metrics move grains once."""
    monkeypatch.setattr(rollups, "TASK_GRAINS", 50)
    asked = []
    monkeypatch.setattr(rollups, "rollup", lambda df, keys, tasks=None: asked.append(tasks) or rollup(df, keys, tasks))
    store = DashboardStore(spark, str(tmp_path / "store"), ["account_id"])
    store.add("u", uploads(1))
    assert asked == [4]
    dealt, whole = (rollup(uploads(1), ["account_id"], tasks) for tasks in (4, None))
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect()))
    assert store.metrics()._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1   # three before
