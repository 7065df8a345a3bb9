import pytest
from llm_tables import DOCS

from tidecast.llm.common import shared_folder


@pytest.fixture(scope="session", autouse=True)
def folder(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return shared_folder(spark)


@pytest.fixture
def documents(spark):
    """Make a documents table from texts, or (doc_id, text) pairs."""

    def make(texts, lang="en"):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make
