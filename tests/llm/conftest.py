import pytest


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use inside."""

    def make(rows):
        cols = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, _may string"
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, 7, "x") for i, t in rows], cols)

    return make


WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(f"word{i % 977} of {i}" for i in range(30_000))
EDGE = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, " ".join(WORDS[:100])), (5, " ".join(WORDS[:100])), (6, " ".join([*WORDS[:97], "x", "y", "z"])), (None, "no id here at all, five words"), (7, LONG), (7, LONG), (8, "\n\n  \n")]


@pytest.fixture(scope="session")
def edge():
    return EDGE
