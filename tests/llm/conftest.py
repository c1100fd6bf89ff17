import pytest

from logsmith.llm import common


@pytest.fixture(scope="session", autouse=True)
def shipped_package(spark):
    common.ship_package(spark)


@pytest.fixture()
def frame(spark):
    """Rows as a DataFrame of several partitions."""

    def make(rows, schema="doc_id long, text string", parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
