import random

import pytest

from blotter.llm.common import prepare


@pytest.fixture(autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture
def words():
    """A function that gives n random words of a small vocabulary."""
    chance = random.Random(7)

    def some(n, vocabulary=400):
        return [f"w{chance.randrange(vocabulary)}" for _ in range(n)]

    return some


#: Rows with nulls in every column, empty and long texts, repeats and clashing names.
EDGE = [
    (1, None, "en", "a", None, 1.0),
    (None, "alpha beta gamma", None, None, 16, None),
    (2, "", "de", "b", 0, 2.0),
    (3, "one two three four five", None, "a", 23, 3.0),
    (3, "one two three four five", None, "a", 23, 3.0),
    (4, "word " * 30_000, "fr", None, 150_000, None),
    (5, " \n\t\n ", "xx", "c", 5, 5.0),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, %s double"


@pytest.fixture
def edge(spark):
    """The rows above; the further column gets the given name."""
    return lambda name="score", rows=EDGE: spark.createDataFrame(rows, EDGE_SCHEMA % name)
