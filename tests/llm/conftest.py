import pytest

EDGE = "doc_id long, text string, lang string, source string, n_chars long, k long, node long, size long, kept string, score string, block int, _id string, label int"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names."""
    extra = (7, 8, 9, "x", "y", 1, "z", 3)
    long = " ".join(f"w{i % 977} x{i % 13}." for i in range(60000))
    rows = [(1, None, "en", "a", 1), (2, "", "en", "a", 0), (3, " \t\n\x0b ", None, None, None), (4, long, "en", "b", 5),
            (5, "One two three four five six. Seven eight nine ten eleven twelve.\nNext line of it here.", "en", None, 5),
            (5, "One two three four five six. Seven eight nine ten eleven twelve.\nNext line of it here.", "en", None, 5),
            (6, "One two three four five six. Seven eight nine ten eleven twelve.\nNext line of it here.", "en", "b", 5),
            (None, "Text of a row without id, which has a password = hunter2hunter2 in it.", "en", "c", 5),
            (8, "é" * 3000 + " ünï ß \U0001F600 x", "de", "c", 5), (9, None, None, None, None)]
    return spark.createDataFrame([r + extra for r in rows], EDGE)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
