import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakewitness.plans.evidence import VERSION_SCHEMA, Evidence  # noqa: E402
from lakewitness.session import build_session  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4)
    yield session
    session.stop()


@pytest.fixture
def compare(spark):
    """Evidence of two small versions, the second a child of the first."""

    def build(schema1, rows1, schema2, rows2, target, task="classification"):
        frames = {1: spark.createDataFrame(rows1, schema1), 2: spark.createDataFrame(rows2, schema2)}
        row = lambda v, parent: (v, 1, 1, "d", v, parent, "manual", "note", "2024-01-01", task, target, "m", "v", "all", [], "none")
        return Evidence(spark, frames, spark.createDataFrame([row(1, None), row(2, 1)], VERSION_SCHEMA))

    return build
