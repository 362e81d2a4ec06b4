"""Operators that SQL can express give the rows of their SQL."""

from __future__ import annotations

import pytest
from oracle import duckdb_rows, spark_rows

from staylens.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operator_matches_sql(spark, name):
    names, rows = spark_rows(QUERIES[name](spark, FOLDER))
    sql_names, sql_rows = duckdb_rows(ORACLE_SQL[name], FOLDER)
    assert names == sql_names
    assert rows.total() == sql_rows.total() > 0
    assert rows == sql_rows, (list((rows - sql_rows))[:3], list((sql_rows - rows))[:3])
