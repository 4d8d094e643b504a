import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp())
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from gleanworks.llm.common import prepare

    return prepare(s)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from texts; ids count from 0."""

    def make(texts, ids=None):
        ids = ids or range(len(texts))
        return spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCUMENTS)

    return make
