import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, _row string"


def words(rnd, n, stem="w"):
    return " ".join(f"{stem}{rnd.randint(0, 400)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows; columns with clashing names."""
    rnd = random.Random(7)
    base = words(rnd, 60)
    return [
        (1, base, "en", "s", 1, "x", "y"), (2, base, "en", None, None, None, None), (3, base + " tail", None, "s", 1, "x", "y"), (4, None, "en", "s", 1, "x", "y"), (5, "", "en", "s", 1, "x", "y"),
        (6, "one", "fr", "s", 1, "x", "y"), (7, "one\n\ntwo  ", "fr", "s", 1, "x", "y"), (None, base, "en", "s", 1, "x", "y"), (9, "é" * 30 + "\n" + base, "fr", "s", 1, "x", "y"), (9, "é" * 30 + "\n" + base, "fr", "s", 1, "x", "y"),
        (10, words(rnd, 30_000), "en", "s", 1, "x", "y"), (11, "\n".join([base] * 4), "en", "s", 1, "x", "y"), (12, "  \t\n", "en", "s", 1, "x", "y"), (13, "7 !! 8", "en", "s", 1, "x", "y"), (14, "日本語" * 50, "ja", "s", 1, "x", "y"), (15, base.upper(), "en", "s", 1, "x", "y"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, KIND)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
