import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import build_session, checkpoint_root  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="ledgerlens-tests")
    checkpoint_root(s)
    yield s
    s.stop()


TXN_SCHEMA = ("account_id string, txn_id long, date date, amount decimal(18,2), merchant string, "
              "description string, category string")


@pytest.fixture
def txns(spark):
    """Build a small transaction frame from tuples
    (account_id, txn_id, 'yyyy-mm-dd' or None, amount, merchant, description, category)."""
    import datetime as dt
    from decimal import Decimal

    def make(rows):
        conv = [(a, t, dt.date.fromisoformat(d) if d else None,
                 None if amt is None else Decimal(str(amt)), m, desc, c)
                for a, t, d, amt, m, desc, c in rows]
        return spark.createDataFrame(conv, TXN_SCHEMA)
    return make
