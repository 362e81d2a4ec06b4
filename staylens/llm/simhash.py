"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in few bits differ in even fewer
in one segment, so a table of each segment's values is looked up with every value of a small
Hamming ball around the segment, and the whole fingerprints of the matches are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.components import components
from staylens.llm.frames import add_columns, batch_rows, unused
from staylens.llm.words import LOWER_ASCII, byte_texts
from staylens.sources.durable import durable, release

SHINGLE_WORDS = 3
MAX_BITS = 3
SEGMENTS = 2
SEED = 42
BITS = 64
# Rows of a bucket that one step compares with each other.
BLOCK = 2048


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's word shingles; 0 without words."""
    found = (text or b"").translate(LOWER_ASCII).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    last = max(len(found) - shingle_words, 0)
    starts = [0, *(ends[:last] + 1).tolist()]
    stops = ends[min(shingle_words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8"
    )
    counts = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), 255):  # as many as a byte can count
        block = hashes[begin : begin + 255].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    set_bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def with_fingerprints(
    frame: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    text: str = "text",
    keep: list[str] | None = None,
    name: str = "fp",
) -> DataFrame:
    """Columns ``keep`` (default: all) and the fingerprint of each whole text as a signed long."""

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            values = [fingerprint(t, shingle_words) for t in byte_texts(batch.column(0))]
            return {name: pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())}

        return work

    return add_columns(frame, [text], f"{name} long", make, keep)


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """Lowest bit and number of bits of each segment."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def segment_radii(segments: int, max_bits: int) -> list[int]:
    """Radius to look up in each segment: any pair within ``max_bits`` is within one of them.

    If every segment differed in more bits than its radius, the whole would differ in more than
    ``max_bits``: the radii sum to ``max_bits - segments + 1``. A radius of -1 needs no look-up.
    """
    least, more = divmod(max_bits - segments + 1, segments)
    return [least + (i < more) for i in range(segments)]


def balls(segments: int, max_bits: int) -> list[list[int]]:
    """For each segment, masks of all changes within its radius."""
    found = []
    for (low, width), radius in zip(segment_bounds(segments), segment_radii(segments, max_bits), strict=True):
        bits = [1 << (low + i) for i in range(width)]
        found.append([sum(c) for r in range(radius + 1) for c in combinations(bits, r)])
    return found


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def probes(fingerprints: DataFrame, segments: int = SEGMENTS, max_bits: int = MAX_BITS) -> DataFrame:
    """``segment``, ``key``, ``fp`` and ``own``: each table entry (own) and each look-up."""
    rows = []
    for i, (bounds, masks) in enumerate(zip(segment_bounds(segments), balls(segments, max_bits), strict=True)):
        low, width = bounds
        inside = F.col("fp").bitwiseAND(F.lit(_signed(((1 << width) - 1) << low)))
        rows += [
            F.struct(
                F.lit(i).cast("byte").alias("segment"),
                inside.bitwiseXOR(F.lit(_signed(mask))).alias("key"),
                F.lit(mask == 0).alias("own"),
            )
            for mask in masks
        ]
    return fingerprints.select("fp", F.explode(F.array(*rows)).alias("p")).select(
        "p.segment", "p.key", "fp", "p.own"
    )


def links(fingerprints: DataFrame, segments: int = SEGMENTS, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a``, ``b`` that join the same fingerprints as all pairs within ``max_bits``.

    ``fingerprints`` has each ``fp`` once. Look-ups that meet no table entry end in the first join.
    A bucket of up to ``BLOCK`` rows is compared at once; larger ones are cut into blocks, and each
    pair of blocks is a group of its own, so no task gets a whole hot bucket. A group gives a
    spanning forest of its pairs: at most as many links as rows, however dense.
    """
    bucket = ["segment", "key"]
    every = probes(fingerprints, segments, max_bits)
    entries = durable(every.where("own").select(*bucket).distinct())
    met = durable(every.join(entries, bucket, "left_semi"))
    sizes = durable(
        met.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
        .select(*bucket, F.ceil(F.col("n") / BLOCK).alias("blocks"))
    )
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    rows = met.join(sizes, bucket).withColumn("block", block)
    # Blocks i <= j of a bucket meet in group (i, j), so each block goes to as many groups as there are blocks.
    meeting = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    grouped = rows.select(*bucket, "block", "fp", "own", meeting).select(
        *bucket,
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        "fp",
        "own",
    )
    order = [*bucket, "i", "j"]
    compared = grouped.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        _compare(max_bits), "a long, b long"
    )
    with batch_rows(fingerprints.sparkSession, 1 << 14):
        found = durable(compared.distinct())
    release(entries, met, sizes)
    return found


def _compare(max_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches):
            pairs = _forest(columns, max_bits)
            if len(pairs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"]
                )

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Whole groups of rows (sorted by the first four columns), several small ones at a time."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(pair) for pair in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        same = np.ones(len(columns[0]), bool)
        for column in columns[:4]:
            same &= column == column[-1]
        # All rows of the last group are at the end.
        cut = len(same) - int(same.sum())
        if cut:
            yield [c[:cut] for c in columns]
        rest = [c[cut:] for c in columns]
    if rest is not None and len(rest[0]):
        yield rest


def _forest(columns: list[np.ndarray], max_bits: int) -> np.ndarray:
    """Spanning links of the near pairs (a table entry and a look-up) in each group."""
    segment, key, i, j, block, signed, own = columns
    fp = signed.astype(np.int64).view(np.uint64)  # bits are counted in what has no sign
    change = np.ones(len(fp), bool)
    change[1:] = (
        (segment[1:] != segment[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    )
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(fp))
    links: list[np.ndarray] = []
    many = (ends - starts > 1) & (np.add.reduceat(own.astype(np.int64), starts) > 0)
    for start, end in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
        values = fp[start:end]
        left = values[own[start:end]]
        cross = None
        if i[start] != j[start]:
            cross = block[start:end]
        near = np.bitwise_count(left[:, None] ^ values[None, :]) <= max_bits
        near &= left[:, None] != values[None, :]
        if cross is not None:
            near &= cross[own[start:end]][:, None] != cross[None, :]
        if not near.any():
            continue
        links.append(_spanning(left, values, near))
    return np.concatenate(links).view(np.int64) if links else np.zeros((0, 2), np.int64)


def _spanning(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> np.ndarray:
    """A forest over the values that joins what the marked pairs join."""
    rows, columns = np.nonzero(near)
    a, b = left[rows], right[columns]
    if len(a) <= len(left) + len(right):
        return np.stack([a, b], axis=1)
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    heads, tails = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        lowest = root.copy()
        np.minimum.at(lowest, heads, root[tails])
        np.minimum.at(lowest, tails, root[heads])
        lowest = np.minimum(lowest, lowest[lowest])
        if (lowest == root).all():
            break
        root = lowest
    keep = root != np.arange(len(nodes))
    return np.stack([nodes[keep], nodes[root[keep]]], axis=1)


def near_duplicates(
    documents: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (default: all), ``fp``, ``component_root`` and ``component_id`` of each row.

    Fingerprints link at ``max_bits`` or fewer differing bits; equal ones are one class, so the
    number of copies does not matter. ``component_root`` is the smallest fingerprint (signed) of the
    component, ``component_id`` its smallest ``doc_id``: null where no row of it has an id. Null and
    empty texts have fingerprint zero, which links like any other. Each row gives a row.

    Texts are read once: the columns kept are stored with the fingerprints.
    """
    added = {"fp", "component_root", "component_id"}
    columns = [c for c in (documents.columns if keep is None else keep) if c.lower() not in added]
    stored = list(dict.fromkeys([*columns, "doc_id"]))
    prints = durable(with_fingerprints(documents, shingle_words, keep=stored))
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), max_bits=max_bits))
    rooted = durable(
        classes.join(roots, classes["fp"] == roots["node"], "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("component_root"))
    )
    ids = durable(rooted.groupBy("component_root").agg(F.min("least").alias("component_id")))
    of_fp = unused(prints, "_fp")
    of_class = durable(
        rooted.join(ids, "component_root").select(F.col("fp").alias(of_fp), "component_root", "component_id")
    )
    release(classes, roots, rooted, ids)
    return prints.join(of_class, F.col("fp") == F.col(of_fp), "left").select(
        *columns, "fp", "component_root", "component_id"
    )


def one_of_each(found: DataFrame) -> DataFrame:
    """One row of each component: that of ``component_id``, of equal ids any one."""
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return own.dropDuplicates(["component_root"])


def hex_digits(column: str = "fp"):
    """Column: a long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
