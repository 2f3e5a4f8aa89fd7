"""Column names, types and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference's: the eight spending
# categories, in the reference's order, and the label for "no category".
CATEGORIES: list[str] = [
    "Dining & Drinks",
    "Groceries & Essentials",
    "Transport",
    "Shopping",
    "Travel",
    "Subscriptions & Services",
    "Entertainment",
    "Fees & Charges",
]
UNCATEGORIZED = "Uncategorized"

# The stored status / type words a posted purchase must carry.
STATUS_POSTED = "Posted"
TYPE_PURCHASE = "Purchase"
TYPE_PAYMENT = "Payment"
PAYMENT_CATEGORY = "Payment/Credit"

# Preview and page sizes.
PREVIEW_ROWS = 12
PAGE_SIZE = 25

# Weekday labels, Monday first.
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

AMOUNT_TYPE = T.DecimalType(18, 2)

# Normalised transaction table (T3), before preparation.
NORMALIZED_COLUMNS = [
    "account_id", "txn_id", "source_file", "dialect",
    "date", "time", "amount", "merchant", "description", "status", "type",
]

# Prepared table (T4): normalised minus status/type, plus month and the
# cleaned description.
PREPARED_COLUMNS = [
    "account_id", "txn_id", "source_file", "dialect",
    "date", "time", "amount", "merchant", "description",
    "month", "parsed_description",
]

CACHE_SCHEMA = T.StructType([
    T.StructField("merchant", T.StringType()),
    T.StructField("parsed_description", T.StringType()),
    T.StructField("category", T.StringType()),
])

REPLY_SCHEMA = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("merchant", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
    ]))),
])
