import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import session  # noqa: E402
from letterflow.operators import skew  # noqa: E402

# The tests make keys of a few rows common.
skew.LEAST_HOT_ROWS = 0


@pytest.fixture(scope="session")
def spark():
    spark = session("8", "8")
    yield spark
    spark.stop()


@pytest.fixture
def frame(spark):
    """frame("a int, b string", [(1, "x"), ...]) with several partitions."""
    def make(schema, rows, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return make


def rows_of(df, *cols):
    """Rows as a sorted list of tuples."""
    df = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in df.collect()), key=repr)
