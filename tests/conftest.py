import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    yield session
    session.stop()


@pytest.fixture
def pages(spark):
    """Page table from ``{stem: [text, ...]}``."""

    def make(docs):
        rows = [(stem, n, text) for stem, texts in docs.items() for n, text in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_stem string, page_num int, text string")

    return make


@pytest.fixture
def docs(spark):
    """Markdown table from ``{stem: text}``."""

    def make(texts):
        return spark.createDataFrame(list(texts.items()), "doc_stem string, markdown string")

    return make
