import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keys string, size int, component string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) rows, with further columns whose names the operators use inside."""

    def make(rows):
        full = [(i, t, "en", None, len(t or ""), "k", 1, None) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "One ONE"), (7, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"),
    (9, "é ü   x \x1c y 😀 z"), (None, "no id at all here"), (10, "word " * 40_000), (11, "x" * 150_000), (12, "1" * 5_000 + "@" * 300),
]
