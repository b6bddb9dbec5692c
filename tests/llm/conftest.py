import pytest


@pytest.fixture
def frame(spark):
    """frame(rows, schema) -> DataFrame"""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
