"""One small session for all tests, with a shared folder of its own."""

import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        .getOrCreate()
    )
    yield session
    session.stop()
