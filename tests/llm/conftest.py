import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, component int, score double"


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(5)
    words = ["the", "of", "idiot", "tion", "Straße", "été", "日本", "a1", "x@y.z", "+1", "4111"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))), rng.choice(["en", "de", None]), "s", 5, "q", 1, 2, 0.5) for i in range(40)]
    rows += [(40, None, "en", None, None, None, None, None, None), (None, "no id here at all", None, "s", 1, "q", 1, 2, 0.5), (41, "", "de", "s", 0, "q", 1, 2, 0.5), (42, " \t\n ", "de", "s", 0, "q", 1, 2, 0.5)]
    rows += [(43, "ab" * 60_000, "en", "s", 1, "q", 1, 2, 0.5), (44, "long text with many words " * 8000, "en", "s", 1, "q", 1, 2, 0.5)]
    rows += [rows[3], rows[3], (45, rows[3][1], "en", "s", 1, "q", 1, 2, 0.5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
