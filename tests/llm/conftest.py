import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and blank texts, a long one, repeated rows, copies and a column that clashes with results' names."""
    words = "of the and to in for with on at by from this that which were been has had".split()
    long = " ".join(words[(i * 7 + i // 11) % len(words)] + str(i % 97) for i in range(60_000))
    base = "the quick brown fox jumps over the lazy dog and runs along the river to the old mill near the town "
    rows = [
        (1, base * 3, "en", "a"), (2, base * 3, "en", "a"), (2, base * 3, "en", "a"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t", "fr", "b"),
        (6, long, "en", "b"), (7, long + " end", "en", "c"), (None, base, "en", "a"), (None, base, "en", None), (8, "1234 5678 !!", "en", "b"),
        (9, "x", "de", "a"), (10, 'password = "abcdefghijkl" é AKIA0123456789ABCD', "en", "c"),
    ]
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
