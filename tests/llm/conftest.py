import pytest

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, removed string, begins int, found string, statistics string, fp long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, and columns that clash with the operators' own."""
    long = " ".join(f"Word{i % 977} and{i % 13}." for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "one", "en", None, 3), (5, long, "en", "b", len(long)), (5, long, "en", "b", len(long)),
        (None, "A text without a number. It has two sentences.", "de", "c", 46), (None, None, None, None, None), (7, "!!! ??? ###", None, "c", 11), (8, "é ß Σ 日本語 \x00 \x1c 👍", "fr", "d", 15),
        (9, "one", "en", "d", 3),
    ]
    return spark.createDataFrame([(*r, 0.5, "x", 1, "y", "z", 3) for r in rows], ODD_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
