from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tremolo-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """Five short texts, two of them flaky, and near copies of each."""
    base = [
        ("thread sleep wait async timeout future", 1),
        ("thread notify executor latch timeout sleep", 1),
        ("assert equals value list size", 0),
        ("assert true parser reads value tokens", 0),
        ("assert null list map builder value", 0),
    ]
    rows = [
        (i, base[i % 5][0] + (f" extra{i}" if i % 2 else ""), base[i % 5][1])
        for i in range(60)
    ]
    return spark.createDataFrame(rows, "id BIGINT, text STRING, label INT").cache()
