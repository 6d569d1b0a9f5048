import pytest

EXTRA = "id long, row long, size long, fp long, bucket int, batch long, score double, keep boolean, votes string, path string, text_ string, rank int, label string, v array<double>"
N_EXTRA = 14


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text, lang, source) tuples; ``extra`` adds columns whose names the operators use inside."""

    def make(rows, extra=False):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + EXTRA if extra else "")
        tail = (None,) * N_EXTRA if extra else ()
        full = [(*r, *((None,) * (4 - len(r))), len(r[1] or ""), *tail) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows and ids, odd characters."""
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "b"), (4, "word", None, "a"), (5, "The cat sat on the mat. " * 3000, "en", "a"),
        (6, "the cat\nsat on\nthe mat", "en", None), (6, "the cat\nsat on\nthe mat", "en", None), (None, "no id here, only words", "en", "c"), (None, None, None, None),
        (7, "é" * 5000, "fr", "a"), (8, "日本語 \U0001f600 text", "en", "a"), (9, "| | | ### $$$", "en", "b"), (10, "a b c", "en", "a"), (11, "A B C", "en", "a"), (7, "same id, other text", "fr", "c"),
    ]
