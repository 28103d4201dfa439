import random

import pytest

WORDS = "the of letter harbour rain with clerk and bureau tide anchor loaf crust baker orbit comet rover sail breeze ledger stamp filing dough yeast".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


CLASHING = {"size": 1, "bin": 2, "rank": 3, "bucket": 4, "keep": 0, "dropped_id": 5, "twice_id": 6, "rep": 7, "ids": 8, "doc": 9, "found": 10, "scores": 11, "key": 12, "part": 13, "start": 14, "quality": 15, "toxic": 16, "n_chars": None}
LONG = "word tail " * 60_000


def odd_rows():
    rng = random.Random(5)
    text = prose(rng, 40)
    return [
        (1, text, "en"), (1, text, "en"), (2, None, "en"), (3, "", None), (4, "  \n\t ", "de"), (None, prose(rng, 30), "en"), (None, None, None), (5, LONG, "en"),
        (6, "🎉🎉 日本語 ﬀ é́ \x00 ok", "fr"), (7, text, "en"), (8, "x", "fr"), (9, "", "en"), (10, prose(rng, 60), "en"), (10, prose(rng, 60), "fr"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that may go wrong, and columns that clash with the operators' own."""
    names = ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame([r + tuple(CLASHING.values()) for r in odd_rows()], f"doc_id bigint, text string, lang string, {names}").repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, 0), (10, 1, 0), (99, 0, 0)], "doc_id bigint, quality int, toxic int")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
