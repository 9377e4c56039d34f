import random

import pytest

SF = "/root/testdata/sf0.001"


def text_of(rng: random.Random, n: int) -> str:
    syllables = ["ba", "ko", "ri", "tu", "men", "sal", "dor", "il", "fe", "xan"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, one id twice and columns of clashing names."""
    rng = random.Random(7)
    long = text_of(rng, 40_000)
    rows = [(1, text_of(rng, 80), "x", 1, "a"), (2, None, None, None, None), (3, "", "x", 3, "b"), (4, " \t\n ", "x", 4, "c"), (5, long, "y", 5, "d"), (6, long, "y", 6, "e"),
            (7, "one", "x", 7, "f"), (7, "one", "x", 7, "f"), (None, text_of(rng, 60), "x", 8, "g"), (None, None, None, None, None), (9, "Ünïcödé 日本語 " * 30, "z", 9, "h")]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, n long, id string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
