import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bipath import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("bipath-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def hand_dti(spark):
    rows = [("D1", "P1"), ("D1", "P2"), ("D2", "P2"), ("D2", "P2"), ("D3", "P9")]
    return spark.createDataFrame(rows, schemas.DTI)


@pytest.fixture(scope="session")
def hand_ppi(spark):
    rows = [
        ("P1", "P3", 0.9),
        ("P3", "P1", 0.4),
        ("P2", "P3", 0.5),
        ("P2", "P4", 0.49),
        ("P1", "P2", 0.8),
        ("P5", "P5", 0.7),
        ("P4", "P1", 0.6),
    ]
    return spark.createDataFrame(rows, schemas.PPI)


def rows(df, *columns):
    """The rows of a small result as a sorted list of tuples."""
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=repr)
