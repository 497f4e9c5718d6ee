import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from accordant import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "accordant-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tests-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def one(spark):
    """Evaluate expressions over one row of named values."""

    def run(expression, **values):
        from pyspark.sql import functions as F

        row = spark.range(1)
        for name, value in values.items():
            if value is None:
                column = F.lit(None).cast("string")
            elif isinstance(value, list):
                column = F.array(*[F.lit(v) for v in value]).cast("array<string>")
            else:
                column = F.lit(value)
            row = row.withColumn(name, column)
        result = row.select(expression.alias("x")).collect()[0]["x"]
        return result

    return run
