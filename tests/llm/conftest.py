import random

import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, row string, document string, set int, spans int, score double, part int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Null columns, empty and very long texts, ties, repeated rows, and extra columns with the operators' own names."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    shared = " ".join(rng.choice(words) for _ in range(80))
    texts = [None, "", "  \t\n", "one", "Ünïcode ｗörds 🎉 " * 3, long, shared, shared, "before " + shared + " after", "x" * 5000, "a b " * 900, shared]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", i, "r", None, 1, None, 0.5, 2) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, shared, None, None, None, None, None, None, None, None, None), (7, "another text of doc seven", "en", "s1", 0, "r", "d", 1, 1, 1.0, 1)]
    return spark.createDataFrame(rows, WIDE)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], WIDE)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
