import pytest
from cases import ODD


@pytest.fixture(scope="session")
def table(spark):
    """A table of documents: rows of (doc_id, text), and columns with names that operators use inside."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            from pyspark.sql import functions as F

            for name in ("n", "seg", "pos", "ids", "score", "key", "rep", "d", "T", "gone", "kept", "__d", "__t", "__g", "__k", "__text", "shard", "h", "items"):
                df = df.withColumn(name, F.lit(1))
        return df

    return make


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD)


@pytest.fixture(scope="session")
def empty(table):
    return table([])
