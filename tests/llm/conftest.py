import pytest

LONG = "wide river " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that may go wrong: nulls, empties, a very long text, repeats, clashing columns."""
    rows = [
        (1, "the cat sat on the mat and the dog sat on the log while it rained", "en", "a"),
        (1, "the cat sat on the mat and the dog sat on the log while it rained", "en", "a"),
        (2, "the  cat sat on the mat and\tthe dog sat on the log while it rained", "en", "b"),
        (3, None, "en", None),
        (4, "", None, "b"),
        (5, " \t\n", "de", "a"),
        (None, "the cat sat on the mat and the dog sat on the log while it rained", None, None),
        (None, None, None, None),
        (6, LONG, "en", "c"),
        (7, "Ünder the MIT License und Größe", "de", "a"),
        (8, "1234 %%% 5678", "fr", "a"),
        (9, "released under the MIT License", None, "é"),
    ]
    rows = [(*r, 7, "x", 3, "y", 1) for r in rows]
    columns = "doc_id long, text string, lang string, source string, _row int, _doc string, size int, _key string, h int"
    return spark.createDataFrame(rows, columns).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
