import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runscope.plans.stage import StageArea  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def area(spark):
    return StageArea(spark, "test")


@pytest.fixture(scope="session")
def runs(spark):
    """16 runs in two blobs with a constant, a sparse, a text column and one infinite value."""
    rows = []
    for i in range(16):
        base = 0.0 if i < 8 else 10.0
        first = float("inf") if i == 0 else base + 0.1 * i
        sparse = {14: 1.0, 15: 2.0}.get(i)
        rows.append((1000 + i, first, 2 * (base + 0.1 * i), 5.0, sparse, "alpha"))
    schema = "shot_id long, feature_1 double, feature_2 double, feature_const double, feature_sparse double, machine string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def blobs(spark):
    rows = [(i, 0.1 * (i % 2), 0.1 * (i // 2)) for i in range(4)]
    rows += [(10 + i, 10 + 0.1 * (i % 2), 10 + 0.1 * (i // 2)) for i in range(4)]
    return spark.createDataFrame(rows, "shot_id long, x double, y double")


def table(df, key="shot_id"):
    return {row[key]: row for row in df.collect()}
