import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from amtskompass.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", 8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over literal inputs: ``one({"a": "x"}, column)`` gives its value."""

    def run(row: dict, column, schema: str | None = None):
        df = spark.createDataFrame([tuple(row.values())], schema or list(row))
        return df.select(column.alias("v")).first()["v"]

    return run
