import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderlens.session import local_session  # noqa: E402
from orderlens.sources.order_items import order_items  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "orderlens-tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def items(spark, folder):
    return order_items(spark, folder).persist()


@pytest.fixture(scope="session")
def frame(items):
    from orderlens.columns import ITEM_ORDER

    return items.toPandas().sort_values(ITEM_ORDER).reset_index(drop=True)
