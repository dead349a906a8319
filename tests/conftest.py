import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewire.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session(
        "tidewire-tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def one(spark):
    """Evaluate one column on one row of given values."""

    def run(col, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[_lit(v).alias(k) for k, v in values.items()])
        return row.select(col.alias("x")).first()["x"]

    def _lit(v):
        from pyspark.sql import functions as F

        if isinstance(v, list):
            return F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
        return F.lit(v)

    return run
