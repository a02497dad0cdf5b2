import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from leadweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Values of one column expression over rows of named strings."""
    def run(rows, function, schema="a string"):
        frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
        numbered = frame.coalesce(1).withColumn("_n", F.monotonically_increasing_id())
        result = function(numbered)
        if not isinstance(result, DataFrame):
            result = numbered.withColumn("out", result)
        return [r["out"] for r in result.orderBy("_n").collect()]
    return run
