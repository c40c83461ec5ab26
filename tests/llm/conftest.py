import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def rows():
    import fixtures

    return fixtures.documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    import fixtures

    return fixtures.table(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    import fixtures

    return spark.createDataFrame([], fixtures.SCHEMA)
