from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def session(spark):
    """The shared session with few partitions: these tests use small frames."""
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark
