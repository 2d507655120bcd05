from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    saved = {}

    def set_(**options):
        for key, value in options.items():
            key = key.replace("__", ".")
            saved.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_
    for key, value in saved.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(params=["apart", "coalesced"])
def many_slices(conf, request):
    """Several range slices although the test data are small."""
    if request.param == "apart":
        conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    else:
        conf(
            spark__sql__shuffle__partitions="16",
            spark__sql__adaptive__coalescePartitions__parallelismFirst="false",
            spark__sql__adaptive__advisoryPartitionSizeInBytes="1KB",
            spark__sql__adaptive__coalescePartitions__minPartitionSize="256B",
        )


