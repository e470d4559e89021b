import pytest

DOCUMENT = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture
def documents(spark):
    """documents([(id, text), …]) -> DataFrame with the columns of the table, and some that clash with helpers."""

    def build(rows, parts=3):
        data = [(i, t, "en", "s", None if t is None else len(t), 7, "x", 0.5) for i, t in rows]
        schema = DOCUMENT + ", row BIGINT, component STRING, score2 DOUBLE"
        return spark.createDataFrame(data, schema).repartition(parts)

    return build


@pytest.fixture
def words():
    """words(n, seed) -> n made-up words."""
    import random

    def build(n, seed):
        rng = random.Random(seed)
        return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]

    return build
