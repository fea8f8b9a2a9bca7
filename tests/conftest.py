import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def small(spark):
    """Five transactions of one morning, one hash twice."""
    day = datetime(2024, 3, 10)
    rows = [
        ("0x5e1", day + timedelta(hours=6, minutes=15), 12.5, 0.25, "confirmed", "0xa7"),
        ("0x88d", day + timedelta(hours=7, minutes=40), 310.0, 1.5, "pending", "0xb2"),
        ("0x5e1", day + timedelta(hours=9, minutes=5), 12.5, 0.25, "confirmed", "0xa7"),
        ("0xc30", day + timedelta(hours=11, minutes=30), 47.0, 0.1, "confirmed", "0xd9"),
        ("0x2fa", day + timedelta(hours=12, minutes=55), 8.0, 0.05, "failed", "0xb2"),
    ]
    return spark.createDataFrame(rows, """transaction_hash string, timestamp timestamp_ntz, amount_usd double,
        gas_fee_usd double, status string, from_address string""")


@pytest.fixture
def records(spark):
    """Build rows of (hash, timestamp, chain, amount, status)."""
    def build(*rows):
        return spark.createDataFrame(list(rows), """transaction_hash string, timestamp timestamp_ntz, chain string,
            amount_usd double, status string""")
    return build
