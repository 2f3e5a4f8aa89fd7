"""Golden cleaning cases (FIXTURES.md §4), each C-step alone, and P7."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import cleaning as cl

GOLDEN = [
    ("Spotify", "Spotify P3DCEA9B48", "Spotify"),
    ("X", "SQ *Joe Cafe HOUSTON TX", "Joe Cafe"),
    ("X", "tst* Noodle Bar", "Noodle Bar"),
    ("X", "Sushi MINATO JP", "Sushi"),
    ("X", "Cafe Austin TX HOUSTON TX", "Cafe"),
    ("X", "Joe houston TX", "Joe houston TX"),
    ("Parking", "PARKING LOT", "KING LOT"),
    ("X", "Netflix Netflix.com/bill", "Netflix"),
    ("Amazon", "AMAZON.COM", "AMAZON.COM"),
    ("Whole Foods", "WHOLE FOODS MARKET", "WHOLE FOODS"),
    ("Starbucks Coffee", "STARBUCKS", "Starbucks Coffee"),
    ("Uber", "UBER *EATS", "EATS"),
    ("Joe", "", "Joe"),
    ("", "", ""),
    ("Shop", "SQ *A", "Shop"),
    ("X", "**Deli   Place-.", "Deli Place"),
    ("X", "SALT LAKE CITY UT", "SALT LAKE"),
    ("X", "PAYPAL *Steam Games", "Steam Games"),
    ("X", "AMAZON MKTPL*Book Shop", "Book Shop"),
    ("X", "PADDLE.NET* Tool Co", "Tool Co"),
    ("X", "ZETTLE_*Market Stall", "Market Stall"),
]


def _clean(spark, rows):
    df = spark.createDataFrame(rows, "merchant string, description string")
    return [r[0] for r in df.select(cl.clean_description("merchant", "description")).collect()]


def test_golden_cases(spark):
    got = _clean(spark, [(m, d) for m, d, _ in GOLDEN])
    for (m, d, want), g in zip(GOLDEN, got):
        assert g == want, (m, d, g, want)


def test_null_inputs_behave_as_empty(spark):
    assert _clean(spark, [(None, None), ("Joe", None)]) == ["", "Joe"]


@pytest.mark.parametrize("step,text,want", [
    (cl.strip_prefix, "SQ *Joe", "Joe"),
    (cl.strip_prefix, "sq*Joe", "Joe"),
    (cl.strip_prefix, "Joe SQ *x", "Joe SQ *x"),
    (cl.strip_location, "Joe HOUSTON TX", "Joe"),
    (cl.strip_location, "A B TX C DC", "A"),
    (cl.strip_domains, "Shop x.com/bill y.org", "Shop"),
    (cl.strip_domains, "AMAZON.COM", "AMAZON.COM"),
    (cl.strip_trailing_code, "Spotify P3DCEA9B48 ", "Spotify"),
    (cl.strip_trailing_code, "Spotify P3DC", "Spotify P3DC"),
    (cl.squeeze, " -Joe   Cafe# ", "Joe Cafe"),
])
def test_each_step(spark, step, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(step(F.col("t"))).first()[0] == want


def test_display_merchant(spark):
    df = spark.createDataFrame([("SQ *Joe's",), ("SQ *AB",), ("Target",)], "d string")
    got = [r[0] for r in df.select(cl.display_merchant("d")).collect()]
    assert got == ["Joe's", "SQ *AB", "Target"]


def test_prefix_list_is_complete():
    assert len(cl.PROCESSOR_PREFIXES) == 61
    assert len(cl.LOCATION_CODES) == 53
