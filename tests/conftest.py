import os
import sys

import pytest

from sf_paths import SF_MID, SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from txsentry.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="txsentry-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tx_small(spark):
    from txsentry.sources.tables import transactions
    return transactions(spark, SF_SMALL)


@pytest.fixture(scope="session")
def tx_mid(spark):
    from txsentry.sources.tables import transactions
    return transactions(spark, SF_MID).persist()
