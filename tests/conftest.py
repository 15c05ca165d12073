import os
import signal

import pytest
from pyspark.sql import SparkSession

#: Seconds that a test may take.
LIMIT = int(os.environ.get("SCHOLIA_TEST_LIMIT", "420"))


def pytest_collection_modifyitems(items):
    """The operators' own folders, whose tests take longest, come last."""
    here = os.path.dirname(__file__)
    items.sort(key=lambda x: os.path.dirname(str(x.path)) != here)


@pytest.fixture(autouse=True)
def limited():
    """A test that does not end fails, and the others go on."""

    def late(*_):
        raise TimeoutError(f"more than {LIMIT} seconds")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(LIMIT)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    top = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{top}/warehouse")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
