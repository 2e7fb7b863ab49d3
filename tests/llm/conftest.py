import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, node long, part int, h string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names the operators use inside."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   ", None, None, 3), (4, "hello there general reader", "en", "b", 26), (4, "hello there general reader", "en", "b", 26),
        (5, long_text, "en", None, len(long_text)), (None, "no id at all but some words here", None, "b", 32), (None, None, None, None, None), (7, "!!! ??? ...", "de", "c", 11), (8, "!!! ??? ...", "de", "c", 11),
        (9, "Grüße aus München, liebe Freunde, und viele Grüße", "de", "a", 50), (10, "日本語のテキスト 🙂 emoji", "ja", "d", 20), (11, long_text, "en", "a", len(long_text)), (12, long_text + " tail", "en", "a", 0),
    ]
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
