"""Answers of finished batches survive a failing run."""

import collections
import glob
import json
import os

import pytest

from ledgerlens.operators import classify as cls
from ledgerlens.operators import journal as jn
from ledgerlens.sources import cache

SCHEMA = "merchant string, parsed_description string, txn_id long"


def _rows(spark, n=100):
    rows = [(f"m{k:03d}", f"d{k % 7}", k) for k in range(n)] + [(None, "x", n), ("m000", "d0", n + 1)]
    return spark.createDataFrame(rows, SCHEMA)


def _counting(folder, broken=()):
    """A classifier that notes every call in a folder and rejects some pairs for good."""
    def fn(prompt, items):
        with open(os.path.join(folder, os.urandom(8).hex()), "w") as out:
            json.dump([[i["merchant"], i["description"]] for i in items], out)
        if any(i["merchant"] in broken for i in items):
            error = type("PermanentClassifierError", (RuntimeError,), {})
            raise error("key rejected")
        return {"results": [{**i, "category": "Travel"} for i in items if i["merchant"] != "m050"]}
    return fn


def _calls(folder):
    return collections.Counter(tuple(p) for f in glob.glob(f"{folder}/*") for p in json.load(open(f)))


@pytest.mark.parametrize("every", [1, 3])
def test_finished_batches_are_not_paid_twice(spark, tmp_path, every):
    calls, root = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()
    df = _rows(spark)
    with pytest.raises(cls.PermanentClassifierError, match="key rejected"):
        cls.categorize(df, cls.BatchClassifier(_counting(str(calls), {"m030"}), pause=0, tasks=2, journal_every=every), cache_root=root)
    first = _calls(calls)
    done = jn.entries(spark, f"{root}/journal").groupBy("status").count().collect()
    done = {r.status: r["count"] for r in done}
    assert done[jn.PERMANENT] == 1 and done.get(jn.ANSWERED, 0) >= (5 if every == 1 else 1) and sum(done.values()) == 6
    # more rows have come since: the batches are other ones now
    more = df.unionByName(spark.createDataFrame([("a new one", "d", 900)], SCHEMA))
    report = {}
    out = cls.categorize(more, cls.BatchClassifier(_counting(str(calls)), pause=0, tasks=2, journal_every=every), cache_root=root, report=report).collect()
    again = _calls(calls)
    assert all(n <= 2 for n in again.values()) and len(again) == 102
    twice = {p for p, n in again.items() if n == 2}
    assert ("m030", f"d{30 % 7}") in twice and len(twice) <= 20 and twice <= set(first)  # the rejected batch alone
    assert report["resumed_pairs"] == 102 - (sum(again.values()) - sum(first.values())) and report["failed_batches"] == 0
    labels = {(r.merchant, r.txn_id): r.category for r in out}
    assert len(out) == 103 and {m for (m, _), c in labels.items() if c != "Travel"} == {"m050"}
    assert cache.load_cache(spark, root).count() == 101  # the pair without an echo is not cached
    assert jn.entries(spark, f"{root}/journal").count() == 0


def test_transient_failures_are_asked_again(spark, tmp_path):
    journal = str(tmp_path / "journal")

    def down(prompt):
        raise ConnectionError

    df, report = _rows(spark, 25), {}
    out = cls.categorize(df, cls.BatchClassifier(down, pause=0), journal=journal, report=report)
    assert {r.category for r in out.collect()} == {"Uncategorized"}
    assert report == {"failed_batches": 2, "batches": 2, "resumed_pairs": 0}
    calls = tmp_path / "calls"
    calls.mkdir()
    out = cls.categorize(df, cls.BatchClassifier(_counting(str(calls)), pause=0), journal=journal, report=report)
    assert {r.category for r in out.collect()} == {"Travel"} and len(_calls(calls)) == 26
    out = cls.categorize(df, cls.BatchClassifier(down, pause=0), journal=journal, report=report)  # all is answered
    assert {r.category for r in out.collect()} == {"Travel"} and report == {"failed_batches": 0, "batches": 0, "resumed_pairs": 26}


def test_a_batch_answered_twice_counts_once(spark, tmp_path):
    journal = str(tmp_path / "journal")
    entry = ("k", 0, '[{"position":1,"merchant":"m","description":"d"}]', "r")
    reply = json.dumps({"results": [{"merchant": "m", "description": "d", "category": "Travel"}]})
    for status, said in (("permanent", "no"), ("answered", reply), ("answered", reply), ("failed", None)):
        jn.append(spark.createDataFrame([(*entry, status, said)], jn.JOURNAL_SCHEMA), journal)
    assert [tuple(r) for r in cls.parse_replies(*jn.answered_batches(spark, journal)).select("merchant", "category").collect()] == [("m", "Travel")]
    jn.clear(spark, journal)
    assert jn.entries(spark, journal).count() == 0
