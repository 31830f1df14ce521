import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, key string"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text), with columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src", len(t or ""), "x", "y") for i, t in rows], DOCS)

    return make
