import random

import pytest
from conftest_llm import COLUMNS, sentence


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows."""

    def made(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(3)

    return made


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, one doc_id twice, and extra columns whose names clash."""
    rng = random.Random(5)
    a, b = sentence(rng, 120), sentence(rng, 90)
    long = sentence(rng, 60_000)
    texts = [(1, a, "en"), (1, a, "en"), (2, a, "en"), (3, None, None), (4, "", "en"), (5, "", "de"), (None, b, "en"), (6, b, None), (7, "  \n \t", "en"), (8, long, "en"), (9, long + " tail", "en"), (10, "one", "en"), (10, "two\ntwo\n\ntwo", "de"), (None, None, None), (11, "!!! ...", "en")]
    rows = [(i, t, lang, None, None, 1, 2.5, "k", 7, None) for i, t, lang in texts]
    return spark.createDataFrame(rows, COLUMNS + ", key long, shard double, near_key string, position long, coin string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 0, 1), (None, 1, 0), (8, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
