"""Queries that SQL can express, against it."""

import pytest

from tabaudit.llm import queries

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()))
    assert got == sorted(duck.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall())
