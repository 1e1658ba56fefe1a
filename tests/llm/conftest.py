import random

import pytest


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
