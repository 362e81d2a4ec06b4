"""Near-duplicate embeddings by products of int8 tiles with rigorous error bounds.

A unit vector u is stored as s*q + e: int8 codes q, a scale s and the rest e, whose norm is known.
The product of two vectors differs from that of their codes by at most |e| + |f| + |e||f| (norms of
the two rests, rounded up), so only pairs whose coded product reaches the limit less that bound can
be links; their cosine is computed from the full vectors in double precision. Tiles whose vectors
are too far apart for any link, by the angles to their pivots, are not multiplied at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.components import components
from staylens.llm.frames import batch_rows, ship
from staylens.sources.durable import durable, release

LIMIT = 0.9
# Distinct vectors and bytes of a tile, and rows of a tile that one product takes.
TILE_ROWS = 8192
TILE_BYTES = 16 << 20
STEP_ROWS = 512
# Vectors that cells are built around, at most; drawn by hash, so any number of rows will do.
PIVOTS = 64
# What rounding may add to a coded product, to an angle and to a cosine.
SLACK = 1e-6


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and upper bounds of the rests' norms of unit vectors."""
    scales = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scales[:, None]).astype(np.int8)
    rests = np.linalg.norm(units - codes * scales[:, None], axis=1) * (1 + SLACK) + 1e-12
    return codes, scales, rests


def near_pairs(a: np.ndarray, b: np.ndarray, limit: float, stats: dict | None = None) -> np.ndarray:
    """Places (in ``a``, in ``b``) of the pairs of rows with a cosine of at least ``limit``."""
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    codes_a, scales_a, rests_a = quantise(a / norm_a[:, None])
    codes_b, scales_b, rests_b = quantise(b / norm_b[:, None])
    found = []
    # Products of int8 codes are whole numbers that float32 holds exactly up to 1,040 dimensions.
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    right = codes_b.astype(kind).T
    for begin in range(0, len(a), STEP_ROWS):
        rows = slice(begin, begin + STEP_ROWS)
        coded = codes_a[rows].astype(kind) @ right
        coded *= scales_a[rows, None].astype(kind)
        coded *= scales_b.astype(kind)
        bound = rests_a[rows, None] + rests_b + rests_a[rows, None] * rests_b + SLACK
        i, j = np.nonzero(coded + bound.astype(kind) >= limit)
        if stats is not None:
            stats["recomputed"] = stats.get("recomputed", 0) + len(i)
        for part in range(0, len(i), 1 << 16):
            p, q = i[part : part + (1 << 16)] + begin, j[part : part + (1 << 16)]
            cosines = np.einsum("ij,ij->i", a[p], b[q]) / (norm_a[p] * norm_b[q])
            near = cosines >= limit
            found.append(np.stack([p[near], q[near]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """``rep`` (a number), ``vector`` (array of double), ``copies`` and ``least`` id of each distinct usable vector.

    Vectors that are null, empty, zero or hold null or non-finite components are left out: they link
    with nothing. ``least`` is null where no row of the class has an id. The numbers hold for one
    evaluation only, so the table is to be stored.
    """
    as_double = F.col("embedding").cast("array<double>")
    usable = F.coalesce(
        F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(as_double, lambda x: x != 0),
        F.lit(False),
    )
    classes = vectors.where(usable).groupBy(as_double.alias("vector")).agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )
    return classes.withColumn("rep", F.monotonically_increasing_id())


def _pivots(classes: DataFrame, rows: int) -> np.ndarray:
    wanted = max(1, min(PIVOTS, rows // TILE_ROWS))
    drawn = classes.orderBy(F.xxhash64("vector"), "vector").limit(wanted).collect()
    longest = max((len(r.vector) for r in drawn), default=1)
    pivots = np.zeros((len(drawn), longest))
    for place, row in enumerate(drawn):
        pivots[place, : len(row.vector)] = row.vector
    # Huge components must not overflow the norm.
    pivots /= np.abs(pivots).max(axis=1, keepdims=True)
    return pivots / np.linalg.norm(pivots, axis=1, keepdims=True)


def _cells(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rep``, ``copies``, number of dimensions, scaled vector, nearest pivot and angle to it."""
    shared = ship(classes.sparkSession, pivots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = shared()
        for batch in batches:
            cells, angles, data, sizes = [], [], [], []
            for vector in batch["vector"]:
                own = np.asarray(vector, np.float64)
                # A power of two: the scaled vector has the same cosines to the last bit.
                own = np.ldexp(own, -int(np.frexp(np.abs(own).max())[1]))
                unit = own / np.linalg.norm(own)
                shared_dims = min(len(unit), pivots.shape[1])
                cosines = pivots[:, :shared_dims] @ unit[:shared_dims]
                cells.append(int(cosines.argmax()))
                angles.append(float(np.arccos(np.clip(cosines.max(), -1, 1))))
                data.append(own.tobytes())
                sizes.append(len(own))
            yield pd.DataFrame({
                "rep": batch["rep"], "copies": batch["copies"], "dims": sizes, "data": data,
                "cell": cells, "angle": angles,
            })

    return classes.mapInPandas(
        place, "rep long, copies long, dims int, data binary, cell int, angle double"
    )


def _links(placed: DataFrame, pivots: np.ndarray, limit: float) -> DataFrame:
    """``node``, ``other``, ``weight``: partial sums of linked copies, and forests of the links.

    Rows with ``other`` null add ``weight`` to the links of ``node``; the others are links that
    join what all links of their two tiles join.
    """
    spark = placed.sparkSession
    tile_rows = F.least(F.lit(TILE_ROWS), F.ceil(F.lit(TILE_BYTES) / (8 * F.col("dims"))))
    counted = placed.groupBy("dims", "cell").agg(F.count("*").alias("n"))
    tiled = durable(
        placed.join(counted, ["dims", "cell"])
        .withColumn("tile", F.pmod(F.xxhash64("data"), F.ceil(F.col("n") / tile_rows)))
        .drop("n")
    )
    tiles = tiled.groupBy("dims", "cell", "tile").agg(
        F.max("angle").alias("furthest")
    )
    tiles = durable(tiles)
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    reach = float(np.arccos(limit)) + 2 * SLACK
    cells = spark.createDataFrame(
        [(i, j, float(between[i, j])) for i in range(len(pivots)) for j in range(i, len(pivots))],
        "cell_a int, cell_b int, between double",
    )
    a = tiles.select(*[F.col(c).alias(f"{c}_a") for c in tiles.columns])
    b = tiles.select(*[F.col(c).alias(f"{c}_b") for c in tiles.columns])
    # Angles obey the triangle inequality: no pair is nearer than the pivots less both tiles' reach.
    pairs = durable(
        F.broadcast(cells).join(a, "cell_a").join(b, "cell_b")
        .where("dims_a = dims_b and (cell_a < cell_b or tile_a <= tile_b)")
        .where(F.col("between") - F.col("furthest_a") - F.col("furthest_b") <= reach)
        .select("dims_a", "cell_a", "tile_a", "cell_b", "tile_b", F.monotonically_increasing_id().alias("pair"))
    )
    sides = [
        pairs.select(
            "pair", F.col("dims_a").alias("dims"), F.col(f"cell_{s}").alias("cell"),
            F.col(f"tile_{s}").alias("tile"), F.lit(s == "b").alias("second"),
            ((F.col("cell_a") == F.col("cell_b")) & (F.col("tile_a") == F.col("tile_b"))).alias("same"),
        ).where(F.lit(s == "a") | ~F.col("same"))
        for s in "ab"
    ]
    members = sides[0].unionByName(sides[1]).join(tiled, ["dims", "cell", "tile"]).select(
        "pair", "second", "same", "rep", "copies", "data"
    )

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        first, second = tile[~tile["second"]], tile[tile["second"]]
        same = bool(tile["same"].iloc[0])
        if same:
            second = first
        if not len(first) or not len(second):
            return pd.DataFrame({"node": [], "other": [], "weight": []}, dtype="Int64")
        matrices = [np.stack([np.frombuffer(x) for x in t["data"]]) for t in (first, second)]
        places = near_pairs(matrices[0], matrices[1], limit)
        reps = [t["rep"].to_numpy() for t in (first, second)]
        copies = [t["copies"].to_numpy() for t in (first, second)]
        p, q = places[:, 0], places[:, 1]
        if same:
            p, q = p[p != q], q[p != q]
        weights = [(reps[0], np.bincount(p, copies[1][q], len(reps[0])))]
        if not same:
            weights.append((reps[1], np.bincount(q, copies[0][p], len(reps[1]))))
        rows = [
            pd.DataFrame({"node": nodes[w > 0], "other": None, "weight": w[w > 0].astype(np.int64)})
            for nodes, w in weights
        ]
        joined = _forest(reps[0][p], reps[1][q])
        rows.append(pd.DataFrame({"node": joined[:, 0], "other": joined[:, 1], "weight": 0}))
        return pd.concat(rows).astype({"other": "Int64"})

    found = durable(
        members.groupBy("pair").applyInPandas(compare, "node long, other long, weight long")
    )
    release(tiled, tiles, pairs)
    return found


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A spanning forest of the links between ``a`` and ``b``."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    heads, tails = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while len(nodes):
        lowest = root.copy()
        np.minimum.at(lowest, heads, root[tails])
        np.minimum.at(lowest, tails, root[heads])
        lowest = np.minimum(lowest, lowest[lowest])
        if (lowest == root).all():
            break
        root = lowest
    keep = root != np.arange(len(nodes))
    return np.stack([nodes[keep], nodes[root[keep]]], axis=1).astype(np.int64)


def near_duplicates(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row of ``vectors``.

    Rows with a cosine of at least ``limit`` link; equal vectors are one class, whose copies link
    with each other. Vectors of different length link with nothing of the other length. Unusable
    vectors (see ``vector_classes``) have no links and are their own component. Rows without an id link
    and count like others; ``component_id`` is the smallest id of the component, null if none has one,
    and then all its rows are kept. Rows that repeat an id are vectors of their own for ``n_links``.

    Every pair of tiles in reach is one group of at most two tiles; it returns one count a vector and
    a spanning forest, never its pairs. Only the pivots reach the driver.
    """
    spark = vectors.sparkSession
    with batch_rows(spark, 4096):
        classes = durable(vector_classes(vectors))
        rows = classes.count()
        if rows:
            pivots = _pivots(classes, rows)
            placed = durable(_cells(classes, pivots))
            found = _links(placed, pivots, limit)
            release(placed)
        else:
            found = spark.createDataFrame([], "node long, other long, weight long")
        roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
        sums = found.where("other is null").groupBy("node").agg(F.sum("weight").alias("linked"))
        rooted = durable(
            classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
            .join(sums.withColumnRenamed("node", "rep"), "rep", "left")
            .select(
                "vector", "least",
                (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("root", "rep").alias("root"),
            )
        )
        ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        of_class = durable(rooted.join(ids, "root").select("vector", "n_links", "component_id"))
        release(classes, found, roots, rooted)
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    of_class = of_class.withColumnRenamed("vector", "_vector")
    joined = own.join(of_class, F.col("vector") == F.col("_vector"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
