import pytest
from llm_cases import DOCUMENTS, ODD, documents


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def some(spark):
    """Half of the smallest table's documents, for brute force."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 100")
