"""Whitening of embeddings: leading principal components to double precision, scaled to unit variance.

Entries are whole numbers x = floor(256 * c). Tasks sum the distinct vectors exactly, then the
products of the centred ones; what reaches the driver is one matrix of the dimensions' size. It is
brought to tridiagonal form by Householder reflections, the leading eigenvalues are found by
bisection on Sturm counts, their vectors by inverse iteration, orthogonalised within clusters of
near eigenvalues. The components are broadcast to project all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.frames import add_columns, ship
from staylens.sources.durable import durable, release

COMPONENTS = 4
SCALE = 256
# Eigenvalues nearer to each other than this share of the largest are a cluster.
CLUSTER = 1e-3
INVERSE_ITERATIONS = 6
_EPS = float(np.finfo(np.float64).eps)
_WIDTHS = [np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8")]


# ---- whole-number vectors


def whole_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """floor(256 * c) of each entry as 64-bit integers; None where a vector or an entry is unusable.

    Entries beyond the range of 64 bits are held at its ends.
    """
    column = column.cast(pa.list_(pa.float64()))
    values = column.flatten()
    flat = values.to_numpy(zero_copy_only=False)  # null entries become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * SCALE)
        usable = np.isfinite(flat)
        inside = np.clip(scaled, -(2.0**63), 2.0**63 - 1024)
        whole = np.where(usable, inside, 0).astype(np.int64)
        whole[usable & (scaled >= 2.0**63)] = np.iinfo(np.int64).max
    found: list[np.ndarray | None] = []
    at = 0
    for size in column.value_lengths().to_pylist():
        if size is None:
            found.append(None)
            continue
        found.append(whole[at : at + size] if usable[at : at + size].all() else None)
        at += size
    return found


def pack(vector: np.ndarray) -> bytes:
    """The vector in the fewest of 2, 4 or 8 bytes an entry, little-endian: equal vectors, equal bytes."""
    low, high = (int(vector.min()), int(vector.max())) if len(vector) else (0, 0)
    for kind in _WIDTHS:
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return vector.astype(kind).tobytes()
    raise AssertionError("unreachable")


def unpack(rows: list[bytes], dims: int) -> np.ndarray:
    """Packed vectors of one length as a matrix of 64-bit integers."""
    found = np.empty((len(rows), dims), np.int64)
    widths = np.array([len(r) // dims for r in rows])
    for kind in _WIDTHS:
        of = np.flatnonzero(widths == kind.itemsize)
        if len(of):
            found[of] = np.frombuffer(b"".join([rows[i] for i in of]), kind).reshape(len(of), dims)
    return found


def fit_list(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``dims`` and ``x`` (packed): each usable, non-empty whole-number vector once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [v for v in whole_vectors(batch.column(0)) if v is not None and len(v)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(v) for v in found], pa.int32()), pa.array([pack(v) for v in found], pa.binary())],
                ["dims", "x"],
            )

    entries = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    return entries.mapInArrow(run, "dims int, x binary").distinct()


# ---- exact sums and centred products


def dimension_sums(fit: DataFrame, dims: int) -> list[int]:
    """Sum of each dimension over the fit list, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * dims
        for batch in batches:
            x = unpack(batch.column(0).to_pylist(), dims)
            if not len(x):
                continue
            small = max(abs(int(x.min())), abs(int(x.max()))) * len(x) < 1 << 62
            part = (x if small else x.astype(object)).sum(axis=0)
            sums = [s + int(p) for s, p in zip(sums, part, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array(map(Decimal, sums), pa.decimal128(38, 0))], ["i", "s"]
        )

    parts = fit.select("x").mapInArrow(run, "i int, s decimal(38,0)")
    rows = parts.groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = [0] * dims
    for r in rows:
        sums[r.i] = int(r.s)
    return sums


def centred_products(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Sum over the fit list of the products of centred vectors: one row a dimension from each task.

    The rows of a dimension are added in the order of the tasks' numbers, so a repeated stage does not
    change the sum. A task holds one matrix of the dimensions' size.
    """
    dims = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for start in range(0, len(rows), 4096):
                centred = unpack(rows[start : start + 4096], dims) - mean
                total += centred.T @ centred
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * dims, pa.int32()), pa.array(range(dims), pa.int32()),
             pa.array([row.tobytes() for row in total], pa.binary())],
            ["part", "i", "products"],
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total = np.zeros(dims)
        for products in rows["products"]:
            total += np.frombuffer(products)
        return pd.DataFrame({"i": [rows["i"].iloc[0]], "products": [total.tobytes()]})

    parts = fit.select("x").mapInArrow(run, "part int, i int, products binary")
    summed = parts.groupBy("i").applyInPandas(add, "i int, products binary").collect()
    found = np.zeros((dims, dims))
    for r in summed:
        found[r.i] = np.frombuffer(r.products)
    return (found + found.T) / 2


# ---- leading eigenvalues and eigenvectors


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, neighbours of it, and the reflections that bring a symmetric matrix to that form.

    Reflection k is a unit vector (or empty: none needed) over the places from k + 1 on.
    """
    a = matrix.astype(np.float64).copy()
    n = len(a)
    reflections = []
    for k in range(n - 2):
        column = a[k + 1 :, k].copy()
        length = np.linalg.norm(column)
        if length == 0 or not np.any(column[1:]):
            reflections.append(np.zeros(0))
            continue
        column[0] += np.copysign(length, column[0])
        v = column / np.linalg.norm(column)
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        w = p - (v @ p) * v
        part -= 2 * (np.outer(v, w) + np.outer(w, v))
        below = a[k + 1 :, k]
        below -= 2 * (v @ below) * v
        a[k, k + 1 :] = below
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_count(diagonal: np.ndarray, squares: np.ndarray, x: float, tiny: float) -> int:
    """How many eigenvalues of the tridiagonal matrix are below ``x``."""
    count, q = 0, 1.0
    for d, square in zip(diagonal.tolist(), [0.0, *squares.tolist()], strict=True):
        q = d - x - square / q
        if abs(q) < tiny:
            q = -tiny
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, beside: np.ndarray, wanted: int) -> list[float]:
    """The largest eigenvalues, falling, by bisection on Sturm counts."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], beside])) + np.abs(np.concatenate([beside, [0.0]]))
    bottom, top = float((diagonal - reach).min()), float((diagonal + reach).max())
    size = max(abs(bottom), abs(top), np.finfo(np.float64).tiny)
    tiny = size * _EPS**2
    squares = beside**2
    found = []
    for k in range(1, min(wanted, n) + 1):
        low, high = bottom - size * _EPS, top + size * _EPS
        while True:
            middle = low + (high - low) / 2
            if not low < middle < high:
                break
            if sturm_count(diagonal, squares, middle, tiny) <= n - k:
                low = middle
            else:
                high = middle
            if high - low <= 2 * _EPS * size:
                break
        found.append(low + (high - low) / 2)
    return found


def _solve(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solves (T - shift) v = right by elimination with row exchanges; zero pivots become tiny."""
    n = len(diagonal)
    main = (diagonal - shift).tolist()
    above = [*beside.tolist(), 0.0]
    second = [0.0] * n
    b = right.tolist()
    lower = beside.tolist()
    for i in range(n - 1):
        if abs(lower[i]) > abs(main[i]):
            factor = main[i] / lower[i]
            main[i], main[i + 1], old = lower[i], above[i], main[i + 1]
            above[i], main[i + 1] = old, main[i + 1] - factor * old
            if i + 1 < n - 1:
                second[i], above[i + 1] = above[i + 1], -factor * above[i + 1]
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
        else:
            if abs(main[i]) < tiny:
                main[i] = tiny
            factor = lower[i] / main[i]
            main[i + 1] -= factor * above[i]
            b[i + 1] -= factor * b[i]
    v = [0.0] * n
    for i in range(n - 1, -1, -1):
        rest = b[i]
        if i + 1 < n:
            rest -= above[i] * v[i + 1]
        if i + 2 < n:
            rest -= second[i] * v[i + 2]
        v[i] = rest / (main[i] if abs(main[i]) >= tiny else tiny)
    return np.array(v)


def eigenpairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling) and their unit vectors, as rows, of a symmetric matrix.

    The largest entry of each vector is positive, the first one of equals.
    """
    n = len(matrix)
    size = float(np.abs(matrix).max(initial=0.0))
    if size == 0:
        return np.zeros(min(wanted, n)), np.eye(n)[:wanted]
    diagonal, beside, reflections = tridiagonal(matrix / size)
    values = leading_eigenvalues(diagonal, beside, wanted)
    spread = max(np.abs(diagonal).max(), np.abs(beside).max(initial=0.0))
    tiny = spread * _EPS
    rng = np.random.default_rng(1)
    vectors: list[np.ndarray] = []
    for k, value in enumerate(values):
        cluster = [j for j in range(k) if values[j] - value <= CLUSTER * spread]
        # Equal eigenvalues are told apart by a little, so that each has a shift of its own.
        shift = value - len(cluster) * 4 * tiny
        v = rng.uniform(0.5, 1.0, n)
        for _ in range(INVERSE_ITERATIONS):
            for _ in range(2):
                for j in cluster:
                    v = v - (vectors[j] @ v) * vectors[j]
            v = _solve(diagonal, beside, shift, v / np.abs(v).max(), tiny)
            v = v / np.abs(v).max()
            v = v / np.linalg.norm(v)
        for _ in range(2):
            for j in cluster:
                v = v - (vectors[j] @ v) * vectors[j]
            v = v / np.linalg.norm(v)
        vectors.append(v)
    found = np.stack(vectors)
    for k in range(len(reflections) - 1, -1, -1):
        r = reflections[k]
        if len(r):
            found[:, k + 1 :] -= 2 * np.outer(found[:, k + 1 :] @ r, r)
    signs = np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])
    return np.array(values) * size, found * signs[:, None]


# ---- the operator


@dataclass
class Whitening:
    """What a projection needs: its size is that of the dimensions, whatever the rows."""

    rows: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def __post_init__(self) -> None:
        self.mean = np.array([s / self.rows for s in self.sums])
        # A component without variance projects everything to 0.
        floor = max(self.trace, 0.0) * len(self.sums) * _EPS
        self.open = self.values > floor
        scale = np.where(self.open, np.sqrt(np.where(self.open, self.values, 1.0)), np.inf)
        self.projection = (self.vectors / scale[:, None]).T

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection

    def explained(self) -> list[float]:
        return [float(v / self.trace) if o else 0.0 for v, o in zip(self.values, self.open, strict=True)]

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - S)^2, exact for any size."""
        n, sums = self.rows, self.sums
        high = np.array([s >> 31 for s in sums], object)
        fits = len(sums) < 1 << 20 and all(-(1 << 31) <= h < 1 << 31 for h in high)
        largest = np.abs(x).max(axis=1, initial=0)
        small = fits & (largest >= 0) & (largest < 1 << 11)
        found: list[int] = [0] * len(x)
        if small.any():
            part = x[small]
            squares = (part * part).sum(axis=1)
            upper = part @ high.astype(np.int64)
            lower = part @ np.array([s & 0x7FFFFFFF for s in sums], np.int64)
            constant = sum(s * s for s in sums)
            for i, a, u, w in zip(np.flatnonzero(small).tolist(), squares.tolist(), upper.tolist(), lower.tolist(), strict=True):
                found[i] = n * n * a - 2 * n * ((u << 31) + w) + constant
        for i in np.flatnonzero(~small).tolist():
            found[i] = sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), sums, strict=True))
        return found


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> tuple[Whitening | None, float]:
    """The whitening of the distinct usable vectors, and how far its covariance is from the identity.

    None where there is no usable vector. Of vectors of several lengths those of the commonest length
    (of equally common ones the longest) among the distinct vectors are taken.
    """
    every = durable(fit_list(vectors, vector))
    common = every.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        release(every)
        return None, 0.0
    dims, rows = common["dims"], common["n"]
    listed = every.where(F.col("dims") == dims)
    sums = dimension_sums(listed, dims)
    covariance = centred_products(listed, np.array([s / rows for s in sums])) / rows
    values, found = eigenpairs(covariance, min(components, dims))
    model = Whitening(rows, sums, values, found, float(np.trace(covariance)))
    error = _identity_error(listed, model)
    release(every)
    return model, error


def _identity_error(listed: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity."""
    shared, dims = ship(listed.sparkSession, model), len(model.sums)
    used = [k for k, is_open in enumerate(model.open) if is_open]
    if not used:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            projected = shared().project(unpack(batch.column(0).to_pylist(), dims))
            yield pa.RecordBatch.from_arrays(
                [pa.array(projected[:, k]) for k in used], [f"w{k}" for k in used]
            )

    whitened = listed.select("x").mapInArrow(run, ", ".join(f"w{k} double" for k in used))
    pairs = [(i, j) for i in used for j in used if i <= j]
    entries = whitened.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c_{i}_{j}") for i, j in pairs]).first()
    return max(abs(entries[f"c_{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", keep: list[str] | None = None
) -> DataFrame:
    """Columns ``keep`` (default: all), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    One row for each usable row; ``whitened`` and ``explained`` are arrays by component, falling
    eigenvalues, at most ``components`` and not more than dimensions. Left out are null and empty
    vectors, those with null or non-finite entries, and those of another length than the commonest.
    Rows that repeat a vector count once in the fit and each give a row. Where the distinct vectors
    have no variance along a component its values are 0, and it is no part of ``identity_error``.
    """
    model, error = fit(vectors, components, vector)
    added = "deviation decimal(38,0), whitened array<double>"
    columns = vectors.columns if keep is None else keep
    taken = {"deviation", "whitened", "n", "explained", "identity_error"}
    columns = [c for c in columns if c.lower() not in taken]
    dims = len(model.sums) if model else 0
    shared = ship(vectors.sparkSession, model)

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            model = shared()
            found = whole_vectors(batch.column(0))
            usable = [i for i, v in enumerate(found) if model and v is not None and len(v) == dims]
            deviations: list[Decimal | None] = [None] * len(found)
            whitened: list[np.ndarray | None] = [None] * len(found)
            if usable:
                x = np.stack([found[i] for i in usable])
                for i, d, w in zip(usable, model.deviations(x), model.project(x), strict=True):
                    # Beyond 38 digits there is no number to return.
                    deviations[i] = Decimal(d) if d < 10**38 else None
                    whitened[i] = w
            return {
                "deviation": pa.array(deviations, pa.decimal128(38, 0)),
                "whitened": pa.array(whitened, pa.list_(pa.float64())),
            }

        return work

    entries = vectors.withColumn(vector, F.col(vector).cast("array<double>")) if vector not in columns else vectors
    projected = add_columns(entries, [vector], added, make, columns).where("whitened is not null")
    return projected.select(
        "*",
        F.lit(model.rows if model else 0).cast("long").alias("n"),
        F.array(*[F.lit(x) for x in (model.explained() if model else [])]).cast("array<double>").alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )


def by_component(whitened: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each row and component (from 1), with the columns ``keep`` and ``n``, ``deviation``."""
    parts = F.arrays_zip("whitened", "explained")
    return whitened.select(*keep, "n", "deviation", "identity_error", F.posexplode(parts).alias("place", "part")).select(
        *keep, (F.col("place") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("part.whitened").alias("whitened"), F.col("part.explained").alias("explained"), "identity_error",
    )
