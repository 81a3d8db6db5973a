import pytest


@pytest.fixture
def docs(spark):
    """Documents with nulls, an empty text, ties, a repeated row and columns whose names clash with internal ones."""

    def make(texts, ids=None, **more):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "src", None if t is None else len(t), 1, "x", 0) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h int, key string, _deleted int")

    return make
