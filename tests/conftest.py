import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlight.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("ledgerlight-tests", **{
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("driver tables not present")
    return path


def rows(df, *order):
    """Rows as plain tuples, sorted."""
    return sorted([tuple(r) for r in df.collect()], key=repr) if not order else [tuple(r) for r in df.orderBy(*order).collect()]
