"""Every registered query against its SQL, over the whole small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from convoframe import session

FOLDER = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        table = name.removesuffix(".parquet")
        connection.execute(f"create view {table} as select * from '{FOLDER}/{name}'")
    return connection


def test_every_query_has_sql():
    assert set(driver.QUERIES) == set(driver.SQL)


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    ours = driver.QUERIES[name](spark, FOLDER)
    theirs = oracle.execute(driver.SQL[name])
    kinds = {column[0]: TYPES[str(column[1])] for column in theirs.description}
    assert dict(ours.dtypes) == kinds
    order = [list(kinds).index(column) for column in sorted(kinds)]
    expected = sorted((tuple(row[i] for i in order) for row in theirs.fetchall()), key=repr)
    found = sorted((tuple(row) for row in ours.select(*sorted(kinds)).collect()), key=repr)
    assert found == expected


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["chat_id", "chat_name", "n_messages"]
    assert result.count() > 0


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_plans_have_no_pairing_join(spark, monkeypatch, name):
    """Of the result and of every intermediate table."""
    shown = []
    see = lambda df: shown.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(session, "observers", [see])
    see(driver.QUERIES[name](spark, FOLDER))
    for plan in shown:
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
