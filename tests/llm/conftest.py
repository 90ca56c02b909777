import pytest

from poiscope.llm.common import importable

CLASHING = "_id long, _text string, _key string, _slice int, row string, id long, host string, a long, b long"


@pytest.fixture(autouse=True)
def reachable(spark):
    importable(spark)


@pytest.fixture
def documents(spark):
    """Builds a table of (doc_id, text), with further columns of names that operators use inside."""

    def build(rows, clashing=True):
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        if clashing:
            for column in CLASHING.split(", "):
                name, kind = column.split()
                df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
        return df

    return build
