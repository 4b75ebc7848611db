import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text[, lang[, source]])."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), None if len(r) < 2 or r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def text_dir():
    return "/root/testdata/sf0.001"
