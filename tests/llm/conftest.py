import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, score double, rejected string, terms string, removed string, row int, _gone long, `a.b` int, _tl_id long, _tl_key string, _tl_row int, _tl_hash string, _tl_spans int, _tl_terms string, _d int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of([(doc_id, text), ...]): documents with columns whose names the operators use too."""

    def make(rows):
        full = [(i, t, "en", f"s{(i or 0) % 3}" if i != 2 else None, None if t is None else len(t), "k", 1, 0.5, "r", "t", "x", 7, 8, 9, 10, "key", 11, "hash", 12, "terms", 13) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    words = " ".join(f"w{i}" for i in range(30))
    return docs_of([(1, None), (2, ""), (3, " \t\n "), (4, words), (5, words), (5, words), (6, "one two"), (None, "no id here"), (None, None), (7, "long " * 40_000), (8, words + " extra")])


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
