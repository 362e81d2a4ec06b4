"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def plain(value: object) -> object:
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else float(f"{value:.12g}")
    return value


def spark_rows(frame: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(frame.columns)
    rows = frame.select(*[f"`{name}`" for name in names]).collect()
    return names, Counter(tuple(map(plain, row)) for row in rows)


def duckdb_rows(sql: str, folder: str) -> tuple[list[str], Counter]:
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = connection.execute(sql)
    found = [column[0] for column in result.description]
    order = sorted(range(len(found)), key=found.__getitem__)
    rows = result.fetchall()
    return [found[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)
