"""Every registered query against its SQL on the smallest tables, and its plan."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from checks import REGISTRY
from verify import comparable

FOLDER = "/root/testdata/sf0.001"
# Grids of 25 fits more; tests/test_models.py runs the same searches on smaller ones.
FITTING = {"logistic_grid_fine", "tree_grid_fine"}
QUERIES = {n: contract.queries()[n] for n in REGISTRY if n not in FITTING}
SQL = contract.oracle_sql()

needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(contract.queries())
    assert contract.entry


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"EvalPython|InPandas|CartesianProduct|BroadcastNestedLoopJoin", plan)
    if name in SQL:
        result = db.sql(SQL[name])
        assert sorted(df.columns) == sorted(result.columns)
        assert comparable(df.columns, rows) == comparable(result.columns, result.fetchall())
    else:
        assert rows
