import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session", autouse=True)
def spill_elsewhere(tmp_path_factory):
    """DuckDB spills into .tmp of the current folder, where a stopped run would leave gigabytes in the repository."""
    import duckdb

    connect, folder = duckdb.connect, str(tmp_path_factory.mktemp("spill"))
    duckdb.connect = lambda *a, **b: connect(*a, **b | {"config": {"temp_directory": folder} | b.get("config", {})})
    yield
    duckdb.connect = connect


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s
