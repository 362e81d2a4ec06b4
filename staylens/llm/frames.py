"""Running a function of Arrow batches over the rows of a DataFrame."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

# Rows of one Arrow batch in a text operator: bounds a task's memory where texts are long.
TEXT_ROWS_PER_BATCH = 1024

Value = TypeVar("Value")
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Sets the rows of an Arrow batch for what runs inside the block."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def ship(spark: SparkSession, value: Value) -> Callable[[], Value]:
    """Broadcasts a value of bounded size with its code; the function gives it inside a task.

    It is unpacked once a Python process and then kept with the broadcast, so tables that the value
    builds for itself are kept as well.
    """
    shared = spark.sparkContext.broadcast({"packed": cloudpickle.dumps(value)})

    def get() -> Value:
        holder = shared.value
        if "value" not in holder:
            holder["value"] = pickle.loads(holder["packed"])
        return holder["value"]

    return get


def slices(batches: Iterable[pa.RecordBatch], rows: int = TEXT_ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``.

    Spark bounds the bytes of what it sends; this bounds what a step makes of it, and leaves the
    session's settings alone.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def unused(frame: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def add_columns(
    frame: DataFrame,
    inputs: list[str],
    added: str,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """The frame's columns ``keep`` (default: all) and the columns of the DDL ``added``.

    ``make`` is called once a task and gives the function from a batch (with the columns
    ``inputs`` named as given) to the added columns. A kept column whose name is also an added
    one gives way to the added one. Rows stay in place: no shuffle.
    """
    new = StructType.fromJson(_parse_datatype_string(added).jsonValue())
    taken = {field.name.lower() for field in new.fields}
    kept = [c for c in (frame.columns if keep is None else keep) if c.lower() not in taken]
    sent = [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(inputs)]
    passed = [F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(kept)]
    types = {field.name: field for field in frame.schema.fields}
    schema = StructType(
        [StructField(f"_keep_{i}", types[c].dataType, True) for i, c in enumerate(kept)]
        + list(new.fields)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            given = pa.RecordBatch.from_arrays(
                [columns[f"_in_{i}"] for i in range(len(inputs))], list(inputs)
            )
            results = work(given)
            arrays = [columns[f"_keep_{i}"] for i in range(len(kept))]
            arrays += [results[field.name] for field in new.fields]
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    result = frame.select(*passed, *sent).mapInArrow(run, schema)
    return result.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(kept)], *new.fieldNames()
    )
