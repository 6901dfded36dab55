"""The driver's contract, and every query of the engine against SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tessera.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def near(a, b):
    return all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=1e-6) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    found = sql.execute(ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert len(got) == len(want) and all(map(near, got, want))


def test_contract(spark):
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 0
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF).count() > 0


def test_nothing_else_imports_the_llm_subpackage():
    import pathlib
    import re

    for path in pathlib.Path(__spark_entry__.__file__).parent.glob("tessera/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
