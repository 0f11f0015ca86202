import pytest

from listwright.llm.common import on_workers
from tests.conftest import SF


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    on_workers(spark)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


# Null ids and texts, empty and blank texts, repeated rows, equal ids with other
# texts, one very long text, and columns named like those that operators make.
LONG = " ".join(f"word{k % 997}x{k}" for k in range(60_000))
AWKWARD = [
    (1, "alpha beta gamma delta epsilon", "a", 1, 0.5, 1),
    (1, "alpha beta gamma delta epsilon", "a", 1, 0.5, 1),
    (1, "another text under the same number", "b", None, 0.5, 1),
    (2, "", "c", 1, None, 1),
    (3, None, None, None, None, None),
    (None, "a text without a number", "d", 1, 0.1, 1),
    (None, None, None, None, None, None),
    (4, " \n \n ", "e", 1, 0.1, 1),
    (5, LONG, "f", 1, 0.1, 1),
    (6, "one\n\ntwo\nthree \n", "g", 1, 0.1, 1),
]
AWKWARD_SCHEMA = "doc_id long, text string, spans string, n long, score double, part long"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, AWKWARD_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], AWKWARD_SCHEMA)
