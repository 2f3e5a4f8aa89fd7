"""O3/O6 order index, P10 trigram index, U2 phrase index, A20 sketches."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as agg
from ledgerlens.operators import classify as cls
from ledgerlens.operators import explore as ex
from ledgerlens.operators import indexes


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(k, dt.date(2024, 1, 1 + rng.randint(0, 27)) if k % 7 else None, Decimal(rng.randint(1, 30)), rng.choice(["Bar", "bar", "Café", None, "x%y_z"]), f"desc {rng.randint(0, 9)} İx", "c") for k in range(500)]
    return spark.createDataFrame(data, "txn_id long, date date, amount decimal(18,2), merchant string, description string, category string")


@pytest.mark.parametrize("column, direction", [("date", "desc"), ("merchant", "asc"), ("amount", "desc")])
def test_index_pages_equal_pages(spark, rows, tmp_path, column, direction):
    root = str(tmp_path / "index")
    indexes.build_order_index(rows, root, column, direction, parts=7)
    want = [tuple(r) for r in ex.sort_transactions(rows, column, direction).collect()]
    for number in (1, 2, 17, 33, 34, 35):
        got = [tuple(r) for r in indexes.indexed_page(spark, root, number, 15).select(*rows.columns).collect()]
        assert got == want[(number - 1) * 15:number * 15]
    assert indexes.indexed_page_count(spark, root, 15) == 34
    files = indexes.indexed_page(spark, root, 20, 15).inputFiles()
    assert 0 < len({f.split("_part=")[1].split("/")[0] for f in files}) <= 2
    indexes.build_order_index(rows.limit(0), str(tmp_path / "none"), column, direction)
    assert indexes.indexed_page_count(spark, str(tmp_path / "none")) == 1


def test_search_index_equals_search(spark, rows, tmp_path):
    root = str(tmp_path / "index")
    indexes.build_search_index(rows, root)
    for query in ("sc 7", "AFÉ", "bar", "a", "", None, "%Y_", "nothing like it", "i̇x", "c 1 İ"):
        want = sorted(r.txn_id for r in ex.search(rows, query).collect())
        assert sorted(r.txn_id for r in indexes.indexed_search(spark, root, query).collect()) == want, query
    candidates, found = indexes.matching_texts(spark, root, "sc 7")
    assert found.count() == 1 and candidates.count() <= 2 and spark.read.parquet(f"{root}/texts").count() >= 13


def test_phrase_index_equals_the_rule_column(spark):
    rng = random.Random(6)
    words = ["ice", "cream", "bar", "shell", "gas", "the", "a1", "x"]
    pairs = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 3))), rng.choice([" ", "-", "  "]).join(rng.choice(words).upper() for _ in range(rng.randint(1, 4)))) for _ in range(300)] + [(None, "ice  cream"), ("Ice", None), (None, None), ("ice-cream", "")]
    df = spark.createDataFrame(sorted(set(pairs), key=str), "merchant string, parsed_description string")
    rules = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), f"c{k}") for k in range(40)]
    table = spark.createDataFrame(rules + [(99, "b.*r", "regex")], "priority long, pattern string, category string")
    phrases, patterns = cls.phrase_rules(table)
    assert [r.pattern for r in patterns.collect()] == ["b.*r"]
    got = {(r.merchant, r.parsed_description): r.category for r in cls.indexed_rule_category(df, phrases).collect()}
    column = cls.rule_category(cls.classify_text(), [cls.Rule(p, c, cls.keyword_pattern([w])) for p, w, c in rules])
    assert got == {(r.merchant, r.parsed_description): r.category for r in df.withColumn("category", column).collect()}
    assert {r.category for r in cls.indexed_rule_category(df, phrases.limit(0)).collect()} == {"Uncategorized"}


def test_phrase_index_has_no_nested_loop(spark):
    phrases = spark.range(10_000).selectExpr("id AS priority", "concat('shop', id, ' branch') AS pattern", "'Travel' AS category")
    df = spark.createDataFrame([("Shop77 branch", "x"), ("shop77", "branch"), ("shop", "y")], "merchant string, parsed_description string")
    out = cls.indexed_rule_category(df, phrases)
    assert {(r.merchant, r.category) for r in out.collect()} == {("Shop77 branch", "Travel"), ("shop77", "Travel"), ("shop", "Uncategorized")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sketches_unite(spark, txns):
    df = txns([(f"k{i % 3}", i, f"2024-0{1 + i % 6}-05", 1, f"m{i * 7 % 3000}", "d", "c") for i in range(6000)])
    monthly = agg.merchant_sketches(df, ["account_id"])
    for keys in ([], ["account_id"], ["month"]):
        exact = {tuple(r)[:-1]: r.n for r in df.withColumn("month", F.date_format("date", "yyyy-MM")).groupBy(*keys).agg(F.count_distinct("merchant").alias("n")).collect()}
        got = {tuple(r)[:-1]: r.merchant_count for r in agg.approx_merchant_count(monthly, keys).collect()}
        assert got.keys() == exact.keys() and all(abs(got[k] - n) <= 4 * 1.04 / 64 * n for k, n in exact.items())
