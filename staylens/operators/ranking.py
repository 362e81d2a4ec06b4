"""Rankings: order-preserving distinct, ranks, unions and reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.functions.text import as_column
from staylens.sources.durable import durable

#: What an order key multiplies page numbers by; positions in a page are array places, so smaller.
PAGE_STEP = 10**10


def order_key(page: Column | str, pos: Column | str) -> Column:
    """Page number and position as one decimal, for pages of any sign and size.

    A decimal minimum aggregates by hash, where that of a struct would sort.
    """
    page, pos = as_column(page).cast("decimal(20,0)"), as_column(pos).cast("decimal(11,0)")
    return (page * F.lit(PAGE_STEP).cast("decimal(11,0)") + pos).cast("decimal(38,0)")


def distinct_first(
    items: DataFrame, keys: Sequence[str], order: str, first: str = "first_pos"
) -> DataFrame:
    """Distinct keys, each with its first place in the order.

    A partial aggregate runs before the shuffle, so a keyword that fills a third of all rows
    still sends one row per task.
    """
    return items.groupBy(*keys).agg(F.min(order).alias(first))


def rank_by_order(
    items: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank"
) -> DataFrame:
    """Rank from 1 by any total order within each key, for keys with any number of rows.

    The rows are range-partitioned by key and order, so a hot key spreads over many tasks, and
    written once with their place in the sorted sequence. The ranks are then the places minus
    the place where the key starts, which needs one small row per key and partition. The table
    keeps the places the same if a lost executor makes Spark repeat a stage.
    """
    placed = durable(
        items.repartitionByRange(*[F.col(key) for key in keys], *order)
        .sortWithinPartitions(*[F.col(key) for key in keys], *order)
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", 33))
    before = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy("_part")
    starts = (
        placed.groupBy(*keys, "_part")
        .agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
        .select(
            *keys,
            "_part",
            "_first",
            F.coalesce(
                F.sum("_n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("_before"),
        )
    )
    same = [F.col(f"p.{key}").eqNullSafe(F.col(f"s.{key}")) for key in keys]
    same.append(F.col("p._part") == F.col("s._part"))
    ranked = placed.alias("p").join(starts.alias("s"), reduce(lambda a, b: a & b, same))
    place = F.col("p._place") - F.col("s._first") + F.col("s._before") + 1
    return ranked.select(*[F.col(f"p.{name}") for name in items.columns], place.alias(rank))


def union_sources(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Frames of several sources in one, each row tagged with the name of its source."""
    tagged = [frame.withColumn("source", F.lit(name)) for name, frame in frames.items()]
    return reduce(lambda left, right: left.unionByName(right), tagged)


def source_report(
    items: DataFrame, sources: Iterable[str] = (), status: Mapping[str, str] | None = None
) -> DataFrame:
    """Rows per source, also for the named ``sources`` without any, which are reported as such.

    ``status`` says how reading a source went; what is not ``ok`` there is the source's status.
    """
    spark = items.sparkSession
    wrong = {name: said for name, said in (status or {}).items() if said != "ok"}
    names = spark.createDataFrame(
        [(name,) for name in dict.fromkeys([*sources, *(status or {})])], "source string"
    )
    # A named source is one more row that does not count: one aggregate, no join.
    every = items.select("source", F.lit(1).alias("_one")).unionByName(
        names.withColumn("_one", F.lit(0))
    )
    n = F.sum("_one")
    said = F.when(n > 0, "ok").otherwise(fv.NO_DATA)
    for name, how in wrong.items():
        said = F.when(F.col("source") == name, how).otherwise(said)
    return every.groupBy("source").agg(n.alias("n"), said.alias("status"))


def counts_by(frame: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key; without keys, rows in all."""
    return frame.groupBy(*keys).agg(F.count("*").alias(name))
