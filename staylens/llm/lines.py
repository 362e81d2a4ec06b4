"""Lines repeated over documents, found with levelled sorted runs of line hashes.

Batches of documents come one after the other. Each batch's line hashes are merge-anti-joined with
the runs, which are tables bucketed and sorted by hash; hashes that no run has are new and enter with
the document that keeps the line, others enter as counts to add. Runs of a level are compacted into
one of the next level when there are enough of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm.frames import add_columns, slices, unused
from staylens.llm.words import LOWER_ASCII, byte_texts
from staylens.sources.durable import durable, release

MIN_KEY_CHARS = 20
MIN_DOCUMENTS = 3
BATCHES = 4
# Runs of a level that are compacted into one of the next.
RUNS_PER_LEVEL = 3

_BLANKS = b" \t\n\x0b\x0c\r"
# Bytes that continue a UTF-8 character.
_CONTINUING = bytes(range(0x80, 0xC0))


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the stripped, lower-cased line; None if it has too few characters."""
    key = line.strip(_BLANKS)
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key.translate(None, _CONTINUING)) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.translate(LOWER_ASCII))


def line_hashes(documents: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``key`` of each distinct long line of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places: list[int] = []
            keys: list[bytes] = []
            for row, text in enumerate(byte_texts(batch.column(2))):
                found = {line_key(line, min_chars) for line in (text or b"").split(b"\n")}
                found.discard(None)
                places += [row] * len(found)
                keys += found
            taken = pa.array(places, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(keys, pa.binary())],
                ["doc_id", "text_hash", "key"],
            )

    return documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id long, text_hash long, key binary"
    )


class LineRuns:
    """Line hashes seen so far: levels of tables bucketed and sorted by hash.

    A row has ``key``, ``n_docs`` (documents to add) and ``keeper`` (document that keeps the line;
    null where an earlier run has named it). A key is in a run at most once.
    """

    def __init__(self, spark: SparkSession, per_level: int = RUNS_PER_LEVEL):
        self._spark = spark
        self._per_level = per_level
        self._buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._levels: list[list[str]] = []
        self._written: set[str] = set()

    def add(self, batch: DataFrame) -> None:
        """Adds a batch (``key``, ``n_docs``, ``keeper``, a key once) as a run of its own.

        It is written in the runs' buckets and order first, so the joins that find what is new in it
        shuffle nothing.
        """
        incoming = self._write(batch)
        try:
            if not self._runs():
                self._push(0, incoming)
                incoming = None
                return
            rows = self._spark.table(incoming)
            fresh = self.unseen(rows)
            again = rows.join(fresh.select("key"), "key", "left_anti")
            counts = again.select("key", "n_docs", F.lit(None).cast("long").alias("keeper"))
            self._push(0, self._write(fresh.unionByName(counts)))
        finally:
            if incoming:
                self._drop([incoming])

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch whose key is in no run: one merge-anti-join for each run."""
        for run in self._runs():
            batch = batch.join(self._spark.table(run).select("key"), "key", "left_anti")
        return batch

    def totals(self) -> DataFrame:
        """One row a key: documents that hold it, and the one that keeps it."""
        runs = [self._spark.table(run) for run in self._runs()]
        if not runs:
            return self._spark.createDataFrame([], "key binary, n_docs long, keeper long")
        return _merged(runs)

    def drop(self) -> None:
        """Removes all runs, also those that a failed step has left."""
        self._drop(list(self._written))
        self._levels = []

    def _runs(self) -> list[str]:
        return [run for level in self._levels for run in level]

    def _push(self, level: int, run: str) -> None:
        if level == len(self._levels):
            self._levels.append([])
        self._levels[level].append(run)
        if len(self._levels[level]) == self._per_level:
            runs = self._levels[level]
            compacted = self._write(_merged([self._spark.table(r) for r in runs]))
            self._levels[level] = []
            self._push(level + 1, compacted)
            self._drop(runs)

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            self._spark.sql(f"DROP TABLE IF EXISTS {run}")
            self._written.discard(run)

    def _write(self, rows: DataFrame) -> str:
        name = f"staylens_run_{uuid4().hex}"
        self._written.add(name)
        rows.repartition(self._buckets, "key").write.bucketBy(self._buckets, "key").sortBy("key").format(
            "parquet"
        ).saveAsTable(name)
        return name


def _merged(runs: list[DataFrame]) -> DataFrame:
    """Merge-joins the runs: their buckets and order fit, so nothing is shuffled for two runs."""
    rows = runs[0]
    for run in runs[1:]:
        other = run.select("key", F.col("n_docs").alias("_more"), F.col("keeper").alias("_keeper"))
        n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("_more", F.lit(0))
        rows = rows.join(other, "key", "full").select(
            "key", n_docs.alias("n_docs"), F.greatest("keeper", "_keeper").alias("keeper")
        )
    return rows


def repeated_lines(
    documents: DataFrame,
    min_chars: int = MIN_KEY_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    batches: int = BATCHES,
) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``keys`` (hashes of the lines to drop), for texts with any.

    Batches go from the largest ids to the smallest, so the batch that brings a hash first also
    holds the largest document that has it. Rows of one id are one document; rows without an id
    are together one document, smaller than all others. Ids may be any, however sparse.
    """
    spark = documents.sparkSession
    bounds = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = bounds if bounds[0] is not None else (0, 0)
    width = (high - low) // batches + 1
    # Whole-number division of decimals: a quotient of doubles or decimals may be rounded up.
    number = F.expr(f"(cast({high}BD as decimal(20,0)) - cast(doc_id as decimal(20,0))) div cast({width}BD as decimal(20,0))")
    number = F.coalesce(F.least(number, F.lit(batches - 1)), F.lit(batches - 1)).cast("int")
    held = durable(line_hashes(documents, min_chars).withColumn("batch", number), "batch")
    runs = LineRuns(spark)
    common = None
    try:
        for batch in range(batches):
            by_document = held.where(F.col("batch") == batch).groupBy("key", "doc_id").agg(F.lit(1))
            runs.add(
                by_document.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
            )
        common = durable(runs.totals().where(F.col("n_docs") >= min_documents).select("key", "keeper"))
        return durable(
            held.select("doc_id", "text_hash", "key").join(common, "key")
            .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("keys"))
        )
    finally:
        runs.drop()
        release(held, common)


def drop_repeated_lines(
    documents: DataFrame,
    min_chars: int = MIN_KEY_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    batches: int = BATCHES,
) -> DataFrame:
    """All columns, ``kept_text``, ``n_lines`` (before) and ``n_dropped`` of each row.

    Lines are parted at line feeds; a null or empty text is one empty line. Lines whose stripped,
    lower-cased form has at least ``min_chars`` characters and is in at least ``min_documents``
    documents stay only in the largest ``doc_id`` that holds them, there with all their repeats.
    Rows are joined to their lines by id and text, so texts of one id don't mix.
    """
    line_id, line_hash, line_keys = (unused(documents, c) for c in ("_line_id", "_line_hash", "_line_keys"))
    dropped = repeated_lines(documents, min_chars, min_documents, batches).select(
        F.col("doc_id").alias(line_id), F.col("text_hash").alias(line_hash), F.col("keys").alias(line_keys)
    )
    joined = documents.join(
        dropped,
        F.col("doc_id").eqNullSafe(F.col(line_id)) & (F.xxhash64("text") == F.col(line_hash)),
        "left",
    ).drop(line_id, line_hash)

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            kept_texts, counts, drops = [], [], []
            for text, keys in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                kept = lines
                if keys:
                    repeated = set(keys)
                    kept = [line for line in lines if line_key(line, min_chars) not in repeated]
                kept_texts.append(b"\n".join(kept))
                counts.append(len(lines))
                drops.append(len(lines) - len(kept))
            return {
                "kept_text": pa.array(kept_texts, pa.binary()).cast(pa.string()),
                "n_lines": pa.array(counts, pa.int64()),
                "n_dropped": pa.array(drops, pa.int64()),
            }

        return work

    added = "kept_text string, n_lines long, n_dropped long"
    return add_columns(joined, ["text", line_keys], added, make, documents.columns)
