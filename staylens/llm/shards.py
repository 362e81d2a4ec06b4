"""Shards of near-equal size by a k-d tree over metadata, split at weighted medians.

A node that is to hold several leaves is split along its widest dimension, at the place that parts
its bytes in proportion to the leaves on either side (the median where they are equal). The place is
found with histograms: each pass counts the bytes of every open node in bounded bins, keeps the bin
that holds the place and cuts it finer in the next pass, until one value is left; ties are parted
along the next dimension of a total order. Open nodes, their bins and their cuts are tables: the
driver learns how many nodes are open, and nothing else that grows with the number of leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.operators.ranking import rank_by_order
from staylens.sources.durable import durable, release

SHARDS = 40
ROW_BYTES = 16
# Bins of one pass over all open nodes; a node has at least MIN_BINS.
BINS = 1 << 15
MIN_BINS = 8
# Rows of a block that are numbered together.
BLOCK_ROWS = 128


def numbered_values(rows: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with ``name``: the place of the column's whole value among its distinct values.

    Values are in the order of their bytes, null (0) before all others. They are reduced to one each
    before they are ranked; Spark decides by size how that is joined, and can split a hot value.
    """
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
    ranked = durable(rank_by_order(values, [], [F.col("_value")], "_place"))
    joined = rows.join(ranked, F.col(column) == F.col("_value"), "left")
    return joined.withColumn(name, F.coalesce("_place", F.lit(0)).cast("long")).drop("_value", "_place", column)


def metadata(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, the dimensions ``d_size`` and ``d_id``, ``lang``, ``source``, ``row``.

    A null id is the smallest; ``row`` parts rows that are equal otherwise.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return documents.select(
        "doc_id",
        size.alias("size"),
        crc.alias("text_crc32"),
        size.alias("d_size"),
        "lang",
        "source",
        F.coalesce("doc_id", F.lit(-(2**63))).alias("d_id"),
        crc.alias("d_crc"),
        F.monotonically_increasing_id().alias("row"),
    )


def grow(rows: DataFrame, dimensions: list[str], ties: list[str], leaves: int) -> DataFrame:
    """The rows (with ``size``) and ``node``, the leaf that each falls into.

    ``dimensions`` are compared by their spread relative to that of all rows; ``ties`` complete
    every order, the last one being unique. Each level of the tree is a table of its own. A node is
    named by its first leaf; one without rows is not split, its leaves stay empty.
    """
    placed = durable(rows.withColumn("node", F.lit(0).cast("long")))
    extremes = [f(d).alias(f"{f.__name__}_{d}") for d in dict.fromkeys([*dimensions, *ties]) for f in (F.min, F.max)]
    whole = placed.agg(*extremes).first()
    if leaves < 2 or whole[0] is None:
        return placed
    opened = rows.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("node"), F.lit(leaves).cast("long").alias("leaves")
    )
    parent = None
    while True:
        splits = durable(_searches(placed, opened, dimensions, len(ties), whole))
        release(parent)
        if splits.isEmpty():
            release(splits)
            return placed
        splits = _seek(placed, splits, dimensions, ties, whole)
        keys = _keys(dimensions, ties)
        below = F.col("up")
        for i in reversed(range(len(keys))):
            lower = (keys[i] < F.col(f"c_{i}")) | ((keys[i] == F.col(f"c_{i}")) & below)
            below = F.when(F.col("n_cut") > i, lower).otherwise(F.col("up"))
        # Rows of closed nodes have no split and stay.
        node = F.when(F.col("below").isNull() | below, F.col("node")).otherwise(F.col("node") + F.col("below"))
        others = [c for c in placed.columns if c != "node"]
        deeper = durable(placed.join(splits, "node", "left").select(*others, node.alias("node")))
        release(placed)
        placed, parent = deeper, splits
        upper = F.struct((F.col("node") + F.col("below")).alias("node"), (F.col("leaves") - F.col("below")).alias("leaves"))
        lower = F.struct("node", F.col("below").alias("leaves"))
        opened = splits.select(F.inline(F.array(lower, upper))).where("leaves > 1")


def _keys(dimensions: list[str], ties: list[str]) -> list[Column]:
    """What a row is compared by: its value along the node's axis, then the ties."""
    return [F.get(F.array(*dimensions), F.col("axis")), *map(F.col, ties)]


def _searches(placed: DataFrame, opened: DataFrame, dimensions: list[str], ties: int, whole) -> DataFrame:
    """A row for each open node that has rows: the start of the search for the place of its split.

    ``axis`` is its widest dimension, ``wanted`` the bytes sought below the place among the keys from
    ``low`` to ``high``; ``c_i`` are the ``n_cut`` parts of the cut found so far, and a row equal to
    a whole cut goes below if ``up``.
    """
    bounds = [f(d).alias(f"{f.__name__}_{d}") for d in dimensions for f in (F.min, F.max)]
    seen = placed.groupBy("node").agg(F.sum("size").alias("bytes"), *bounds).join(opened, "node")
    spreads = [
        (F.col(f"max_{d}").cast("double") - F.col(f"min_{d}").cast("double"))
        / float(max(1, whole[f"max_{d}"] - whole[f"min_{d}"]))
        for d in dimensions
    ]
    spread = F.array(*spreads)
    described = seen.withColumn("axis", (F.array_position(spread, F.array_max(spread)) - 1).cast("int"))
    below = F.floor(F.col("leaves") / 2).cast("long")
    return described.select(
        "node",
        "leaves",
        below.alias("below"),
        "axis",
        (F.col("bytes") * (below / F.col("leaves"))).alias("wanted"),
        F.get(F.array(*[f"min_{d}" for d in dimensions]), F.col("axis")).cast("long").alias("low"),
        F.get(F.array(*[f"max_{d}" for d in dimensions]), F.col("axis")).cast("long").alias("high"),
        F.lit(0).alias("n_cut"),
        *[F.lit(None).cast("long").alias(f"c_{i}") for i in range(ties + 1)],
        F.lit(False).alias("up"),
        F.lit(True).alias("seeking"),
    )


def _seek(placed: DataFrame, splits: DataFrame, dimensions: list[str], ties: list[str], whole) -> DataFrame:
    """The table of searches with all cuts found, all nodes at once; a finer histogram each pass."""
    keys = _keys(dimensions, ties)
    while True:
        nodes = splits.where("seeking").count()
        if not nodes:
            return splits
        bins = max(MIN_BINS, BINS // nodes)
        inside, value = F.lit(True), keys[0]
        for i, key in enumerate(keys):
            inside &= (F.col("n_cut") <= i) | (key == F.col(f"c_{i}"))
            value = F.when(F.col("n_cut") == i, key).otherwise(value)
        # Decimals, for the range of an id may exceed a long's; whole division, for bins must not be rounded.
        width = f"((cast(high as decimal(20,0)) - cast(low as decimal(20,0))) div cast({bins} as decimal(20,0)) + 1)"
        offset = "(cast(value as decimal(20,0)) - cast(low as decimal(20,0)))"
        counted = (
            placed.join(splits.where("seeking"), "node")
            .where(inside)
            .select("node", "wanted", "size", "low", "high", value.alias("value"))
            .where("value between low and high")
            .withColumn("bin", F.expr(f"{offset} div cast({width} as decimal(20,0))"))
            .groupBy("node", "wanted", "bin")
            .agg(
                F.sum("size").alias("bytes"), F.count("*").alias("n"),
                F.min("value").alias("least"), F.max("value").alias("most"),
            )
        )
        # A window holds the bins of one node, which are bounded.
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        summed = counted.withColumn("upto", upto)
        found = F.struct("bin", (F.col("upto") - F.col("bytes")).alias("before"), "bytes", "n", "least", "most")
        reached = F.when(F.col("upto") >= F.col("wanted"), found)
        chosen = summed.groupBy("node").agg(F.coalesce(F.min(reached), F.max(found)).alias("bin"))
        step = durable(splits.join(chosen, "node", "left").select(*_narrowed(ties, whole)))
        release(splits)
        splits = step


def _narrowed(ties: list[str], whole) -> list[Column]:
    """The columns of a search after a pass that chose ``bin``; null leaves it as it is."""
    least, most = F.col("bin.least"), F.col("bin.most")
    wanted = F.when(F.col("bin").isNotNull(), F.col("wanted") - F.col("bin.before")).otherwise(F.col("wanted"))
    narrower = F.col("bin").isNotNull() & (least < most)
    # One value holds the place: rows of this value are parted by the next dimension.
    one = F.col("bin").isNotNull() & (least == most)
    further = one & (F.col("bin.n") > 1) & (F.col("n_cut") < len(ties))
    lows, highs = (F.array(*[F.lit(whole[f"{end}_{t}"]).cast("long") for t in ties]) for end in ("min", "max"))
    return [
        F.col("node"), F.col("leaves"), F.col("below"), F.col("axis"),
        wanted.alias("wanted"),
        F.when(narrower, least).when(further, F.get(lows, F.col("n_cut"))).otherwise(F.col("low")).alias("low"),
        F.when(narrower, most).when(further, F.get(highs, F.col("n_cut"))).otherwise(F.col("high")).alias("high"),
        F.when(one, F.col("n_cut") + 1).otherwise(F.col("n_cut")).alias("n_cut"),
        *[
            F.when(one & (F.col("n_cut") == i), least).otherwise(F.col(f"c_{i}")).alias(f"c_{i}")
            for i in range(len(ties) + 1)
        ],
        # A single row goes to the side where more of it belongs.
        F.when(one & ~further, wanted * 2 >= F.col("bin.bytes")).otherwise(F.col("up")).alias("up"),
        (narrower | further).alias("seeking"),
    ]


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with ``name``: their number within ``group``, from 0 without gaps.

    A group is cut by hash into blocks of about ``BLOCK_ROWS`` rows; blocks are numbered inside, and
    offset by the sizes of those before. So no task gets a whole group.
    """
    # A table, so that its size is known when Spark decides whether to broadcast it.
    counted = durable(rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_blocks")))
    block = F.pmod(F.xxhash64(*order), F.col("_blocks"))
    cut = durable(rows.join(counted, group).withColumn("_block", block).drop("_blocks"))
    release(counted)
    sizes = cut.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = durable(sizes.select(group, "_block", F.coalesce(before, F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order)) - 1
    return (
        cut.withColumn("_inside", inside).join(offsets, [group, "_block"])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_block", "_before", "_inside")
    )


def leaves_for(rows: DataFrame, target_bytes: int) -> int:
    """Leaves so that each holds about ``target_bytes``; one for no rows."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-total // target_bytes))


def shard(documents: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of each row.

    With ``target_bytes`` the number of shards follows from the total. Shards differ in size by about
    one document: each cut is exact to a row, as all orders end in one that parts repeated rows. A
    null text has size 16 and the checksum of no bytes; a null id is kept and sorts first. An empty
    table gives no rows; shards beyond the number of rows stay empty.
    """
    described = durable(metadata(documents))
    rows = durable(numbered_values(numbered_values(described, "lang", "d_lang"), "source", "d_source"))
    release(described)
    leaves = leaves_for(rows, target_bytes) if target_bytes else shards
    dimensions = ["d_size", "d_lang", "d_source", "d_id"]
    placed = grow(rows, dimensions, ["d_id", "d_crc", "row"], leaves)
    release(rows)
    named = placed.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), "row")
    result = numbered(named, "shard", ["doc_id", "row"], "slot")
    release(placed)
    return result.select("doc_id", "size", "text_crc32", "shard", "slot")
