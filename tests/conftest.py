import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dayloom.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_panel(spark):
    """Rows of (entity, day number, values...) -> panel with real dates."""
    from pyspark.sql import functions as F

    def make(rows, cols):
        df = spark.createDataFrame(rows, "e string, d int, " + cols)
        names = [c.split()[0] for c in cols.split(",")]
        return df.select("e", F.expr("date_add(date'2024-01-01', d)").alias("date"), *[n.strip() for n in names])

    return make
