"""Connected components of a graph given as a table of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.sources.durable import durable, release


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for each node of a link ``a``, ``b``.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks to
    their ends and contracts the links to those ends, until none is left. Tables are written after
    each step and read again, so lineage stays short; only their row counts reach the driver. The
    links of a hub are reduced to a minimum before they are shuffled, and joins are between tables,
    so Spark can split a hub's rows. Links with a null end or from a node to itself join nothing and
    give no node; without links there are no rows.
    """
    live = durable(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("hi <> lo").distinct()
    )
    nodes = live.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    labels = durable(nodes.select("node", F.col("node").alias("root")))
    while not live.isEmpty():
        hooks = _followed(durable(live.groupBy("hi").agg(F.min("lo").alias("lo"))))
        relabelled = durable(_replaced(labels, "root", hooks))
        release(labels)
        labels = relabelled
        moved = _replaced(_replaced(live, "hi", hooks), "lo", hooks)
        contracted = durable(
            moved.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
            .where("hi <> lo").distinct()
        )
        release(live, hooks)
        live = contracted
    release(live)
    return labels


def _replaced(frame: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """The frame with ``column`` replaced by what it hooks to, if anything."""
    to = hooks.select(F.col("hi").alias("_from"), F.col("lo").alias("_to"))
    joined = frame.join(to, F.col(column) == F.col("_from"), "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def _followed(hooks: DataFrame) -> DataFrame:
    """Hooks that all lead to an end: each round follows twice as many as the one before."""
    while True:
        to = hooks.select(F.col("hi").alias("_from"), F.col("lo").alias("_to"))
        joined = hooks.join(to, F.col("lo") == F.col("_from"), "left")
        followed = durable(
            joined.select("hi", F.coalesce("_to", "lo").alias("lo"), F.col("_to").isNotNull().alias("went_on"))
        )
        release(hooks)
        if followed.where("went_on").isEmpty():
            return followed
        hooks = followed
