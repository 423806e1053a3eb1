import pytest


@pytest.fixture(scope="session")
def tokenizer_path():
    from peptrail.llm.queries import tokenizer_file

    return tokenizer_file()


@pytest.fixture()
def docs_of(spark):
    """A documents table of (doc_id, text) rows; sources alternate."""

    def make(rows):
        full = [(i, t, "en", None if i is None else f"s{i % 3}", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
