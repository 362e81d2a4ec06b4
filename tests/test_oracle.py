"""Every registered query gives the rows of its SQL."""

from __future__ import annotations

import pytest
from oracle import duckdb_rows, spark_rows

import __spark_entry__ as entry_point
from staylens.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    names, rows = spark_rows(entry_point.queries()[name](spark, FOLDER))
    sql_names, sql_rows = duckdb_rows(entry_point.oracle_sql()[name], FOLDER)
    assert names == sql_names
    assert rows.total() == sql_rows.total() > 0
    assert rows == sql_rows, (list((rows - sql_rows))[:3], list((sql_rows - rows))[:3])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLE_SQL) <= set(entry_point.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize(
    ("name", "rows"),
    [
        ("rank_dedup", 765),
        ("rooms_explode", 60257),
        ("value_topk", 125),
        ("page_prefix", 85),
    ],
)
def test_expected_sizes(spark, name, rows):
    assert entry_point.queries()[name](spark, FOLDER).count() == rows
