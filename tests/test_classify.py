"""Rules, cache, pluggable batches, replies."""

import json

from pyspark.sql import functions as F

from ledgerlens.operators import classify as cls
from ledgerlens.schema import UNCATEGORIZED
from ledgerlens.session import scratch_path
from ledgerlens.sources import cache as cache_mod


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "merchant string, parsed_description string")


def test_rule_priorities(spark):
    df = _pairs(spark, [("Uber", "EATS"), ("Uber", "Trip"), ("Shell", "Oil 55"), ("Joe", "Barber Shop"),
                        ("Costco", "Electronics dept"), ("Costco", "Wholesale"), ("Lot", "Parking Garage"),
                        ("City", "Park"), ("X", "Late Fee"), ("Q", "zzz")])
    got = [r.category for r in cls.categorize(df).collect()]
    assert got == ["Dining & Drinks", "Transport", "Transport", UNCATEGORIZED, "Shopping",
                   "Groceries & Essentials", "Transport", "Entertainment", "Fees & Charges", UNCATEGORIZED]


def test_rules_from_table(spark):
    t = spark.createDataFrame([(1, "zzz", "Travel")], "priority int, pattern string, category string")
    rules = cls.rules_from_table(t)
    out = cls.categorize(_pairs(spark, [("Q", "zzz"), ("Q", "a")]), rules).collect()
    assert [r.category for r in out] == ["Travel", UNCATEGORIZED]


def test_batch_classifier_paths(spark):
    def fn(prompt, items):
        out = []
        for it in items:
            if it["description"] == "alter":
                out.append({"merchant": it["merchant"] + "!", "description": it["description"], "category": "Travel"})
            elif it["description"] == "odd":
                out.append({"merchant": it["merchant"], "description": it["description"], "category": "Pets"})
            else:
                out.append({"merchant": it["merchant"], "description": it["description"], "category": "Shopping"})
        return json.dumps({"results": out})

    rows = [("m", f"d{i:02d}") for i in range(45)] + [("m", "alter"), ("m", "odd"), ("m", "d00")]
    df = _pairs(spark, rows)
    out = cls.categorize(df, cls.BatchClassifier(fn, batch_size=20, pause=0))
    got = {(r.parsed_description): r.category for r in out.collect()}
    assert out.count() == len(rows)
    assert got["alter"] == UNCATEGORIZED and got["odd"] == "Pets" and got["d07"] == "Shopping"
    sizes = cls.build_prompts(cls.assign_batches(cls.distinct_pairs(df), 20)).select("items").collect()
    assert sorted(r["items"] for r in sizes) == [7, 20, 20]
    audit = cls.taxonomy_audit(out).collect()
    assert [(r.category, r["count"]) for r in audit] == [("Pets", 1)]


def test_reply_budget_reaches_the_classifier(spark):
    def fn(prompt, items, max_tokens):
        ok = max_tokens == max(256, 40 * len(items))
        return {"results": [{"merchant": it["merchant"], "description": it["description"],
                             "category": "Shopping" if ok else "Travel"} for it in items]}

    df = _pairs(spark, [("m", f"d{i:02d}") for i in range(27)])
    budgets = cls.build_prompts(cls.assign_batches(cls.distinct_pairs(df), 20)).collect()
    assert sorted((r["items"], r.max_tokens) for r in budgets) == [(7, 280), (20, 800)]
    out = cls.categorize(df, cls.BatchClassifier(fn, batch_size=20, pause=0))
    assert {r.category for r in out.collect()} == {"Shopping"}


def test_classifier_calls_spread_over_tasks(spark):
    import os
    import threading

    def fn(prompt, items):
        # Which Python worker and thread served the call.
        tag = f"{os.getpid()}-{threading.get_ident()}"
        return {"results": [{"merchant": it["merchant"], "description": it["description"],
                             "category": tag} for it in items]}

    df = _pairs(spark, [("m", f"d{i:03d}") for i in range(160)])
    out = cls.categorize(df, cls.BatchClassifier(fn, batch_size=20, pause=0, tasks=4, threads=2))
    assert out.count() == 160
    assert len({r.category for r in out.select("category").distinct().collect()}) > 1


def test_malformed_reply_and_retry(spark):
    state = {"n": 0}

    def flaky(prompt):
        state["n"] += 1
        raise RuntimeError("down")

    df = _pairs(spark, [("a", "b"), ("c", "d")])
    out = cls.categorize(df, cls.BatchClassifier(flaky, pause=0))
    assert {r.category for r in out.collect()} == {UNCATEGORIZED}

    def garbage(prompt):
        return "not json"
    out = cls.categorize(df, cls.BatchClassifier(garbage, pause=0))
    assert {r.category for r in out.collect()} == {UNCATEGORIZED}


def test_prompt_text(spark):
    batched = cls.assign_batches(_pairs(spark, [("B", "y"), ("A", "x")]), 20)
    p = cls.build_prompts(batched).first()
    assert p.prompt == ('Classify these transactions:\n1. Merchant: "A"  Description: "x"\n'
                        '2. Merchant: "B"  Description: "y"')


def test_global_index_is_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    ranked = cls.global_index(df, ["k"], "r", partitions=5).collect()
    assert sorted(r.r for r in ranked) == list(range(1, 1001))
    assert all(r.r == r.k + 1 for r in ranked)


def test_cache_upsert_versions(spark):
    root = scratch_path(spark, "cache")
    assert cache_mod.load_cache(spark, root).count() == 0
    v1 = cache_mod.upsert_cache(spark, root, spark.createDataFrame(
        [("m", "a", "Travel"), ("m", "b", "Shopping")], "merchant string, parsed_description string, category string"))
    v2 = cache_mod.upsert_cache(spark, root, spark.createDataFrame(
        [("m", "b", "Travel"), ("m", "c", "Transport")], "merchant string, parsed_description string, category string"))
    assert (v1, v2) == (1, 2)
    none = spark.createDataFrame([], "merchant string, parsed_description string, category string")
    assert cache_mod.upsert_cache(spark, root, none) == 2 and cache_mod.versions(spark, root) == [1, 2]
    got = {r.parsed_description: r.category for r in cache_mod.load_cache(spark, root).collect()}
    assert got == {"a": "Travel", "b": "Travel", "c": "Transport"}


def test_cache_is_compacted_and_keeps_newest_labels(spark, tmp_path):
    root = str(tmp_path / "cache")
    pairs = lambda *rows: spark.createDataFrame(rows, "merchant string, parsed_description string, category string")
    for k in range(7):
        assert cache_mod.upsert_cache(spark, root, pairs(("m", f"d{k % 5}", f"c{k}"), (None, "n", f"c{k}")), compact_every=3) == k + 1
    assert cache_mod.numbered_folders(spark, root, "full") == [3, 6]
    want = {(None, "n"): "c6", ("m", "d0"): "c5", ("m", "d1"): "c6", ("m", "d2"): "c2", ("m", "d3"): "c3", ("m", "d4"): "c4"}
    load = lambda: {(r.merchant, r.parsed_description): r.category for r in cache_mod.load_cache(spark, root).collect()}
    assert load() == want
    (tmp_path / "cache" / "full=6" / "_SUCCESS").unlink()   # a copy that was not finished
    (tmp_path / "cache" / "v=9").mkdir()                                      # a version that was not finished
    assert load() == want
    assert cache_mod.upsert_cache(spark, root, pairs(("m", "d0", "new")), compact_every=3) == 10
    assert load() == {**want, ("m", "d0"): "new"}


def test_categorize_with_cache_writes_new_pairs(spark):
    root = scratch_path(spark, "cache2")
    cache_mod.upsert_cache(spark, root, spark.createDataFrame(
        [("Q", "zzz", "Travel")], "merchant string, parsed_description string, category string"))
    cached = cache_mod.load_cache(spark, root)
    df = _pairs(spark, [("Q", "zzz"), ("Q", "zzz"), ("Uber", "Trip")])
    out = cls.categorize(df, cache=cached, cache_root=root)
    assert sorted(r.category for r in out.collect()) == ["Transport", "Travel", "Travel"]
    assert cache_mod.load_cache(spark, root).count() == 2
    cov = cls.coverage(out).first()
    assert (cov.done, cov.total) == (2, 2)


def test_cache_labels_only_the_datas_pairs(spark):
    """J2 as one left join: hits keep the cached label (even a NULL one, which
    attaches as Uncategorized), misses are classified, and a cache far
    larger than the data adds nothing to the row join's lookup side."""
    big = spark.range(5000).select(F.lit("C").alias("merchant"),
                                   F.concat(F.lit("d"), F.col("id").cast("string")).alias("parsed_description"),
                                   F.lit("Travel").alias("category"))
    cache = big.unionByName(spark.createDataFrame(
        [("N", "x", None)], "merchant string, parsed_description string, category string"))
    pairs = _pairs(spark, [("C", "d7"), ("N", "x"), ("Uber", "Trip"), (None, "d7")]).select(*cls.PAIR_KEYS)
    labelled = {(r.merchant, r.parsed_description): (r._hit, r.category)
                for r in cls.cache_labels(pairs, cache).collect()}
    assert labelled == {("C", "d7"): (True, "Travel"), ("N", "x"): (True, None),
                        ("Uber", "Trip"): (False, None), (None, "d7"): (False, None)}
    df = _pairs(spark, [("C", "d7"), ("C", "d7"), ("N", "x"), ("Uber", "Trip")])
    out = {(r.merchant, r.parsed_description): r.category for r in cls.categorize(df, cache=cache).collect()}
    assert out == {("C", "d7"): "Travel", ("N", "x"): UNCATEGORIZED, ("Uber", "Trip"): "Transport"}


def test_unwrap_envelope_and_parse(spark):
    reply = json.dumps({"results": [{"merchant": "m", "description": "d", "category": "Travel"}]})
    body = json.dumps({"choices": [{"message": {"content": reply}}]})
    replies = spark.createDataFrame([(0, body), (1, "{}")], "batch_id long, reply string")
    batched = spark.createDataFrame([(0, 1, "m", "d"), (1, 1, "x", "y")],
                                    "batch_id long, position long, merchant string, parsed_description string")
    out = {r.merchant: r.category for r in cls.parse_replies(cls.unwrap_envelope(replies), batched).collect()}
    assert out == {"m": "Travel", "x": UNCATEGORIZED}


def test_observe_coverage(spark):
    df = _pairs(spark, [("Uber", "Trip"), ("Q", "zzz"), ("Shell", "Oil")])
    observed, obs = cls.observe_coverage(cls.categorize(df))
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 3, "categorised": 2}
