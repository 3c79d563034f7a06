import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls anywhere, empty and very long texts, repeated rows, equal ids, clashing names."""
    long = "word%d and some more, é漢 text " * 1
    rows = [
        (1, "One two three four five six seven eight nine ten.", "en", "a", 5),
        (1, "One two three four five six seven eight nine ten.", "en", "a", 5),
        (1, "Another text under the same id, of some eight words or more.", "en", "a", 5),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "de", None, 4),
        (None, "A row without any id, of some eight words or more.", "en", "b", 1),
        (None, "A row without any id, of some eight words or more.", "en", "b", 1),
        (5, "".join(long % k for k in range(6000)), "en", "b", 1),
        (6, "x" * 70_000, None, "c", 1),
        (7, "12 34 !!! ??", "fr", "c", 1),
        (8, "two words", "fr", "c", 1),
        (9, "é", "fr", "c", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy string, row int, id long, node long, text_hash long, score double, spans string, n_lines int, key string, label int"
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
