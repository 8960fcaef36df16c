"""One session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from dyadica.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows and a DDL schema to a DataFrame over two partitions, with columns that clash with inner names."""

    def make(rows, schema, clash=False):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema).repartition(2)
        if clash:
            for name in ("key", "t", "r", "id", "rid", "text_id", "term", "s", "n", "_text"):
                if name not in df.columns:
                    df = df.withColumn(name, F.lit("clash"))
        return df

    return make
