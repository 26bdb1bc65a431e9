import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from paylens.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def transactions(spark):
    """Makes transactions of (counterparty, amount, day) rows; ids count from 1."""
    from datetime import date
    from decimal import Decimal

    def make(rows, description="selgitus"):
        data = [
            (str(i), date.fromisoformat(day), name, Decimal(str(amount)), description, "EUR")
            for i, (name, amount, day) in enumerate(rows, 1)
        ]
        return spark.createDataFrame(
            data,
            "tx_id string, booking_date date, counterparty string, amount decimal(18,2), "
            "description string, currency string",
        )

    return make
