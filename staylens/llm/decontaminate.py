"""Benchmark passages in documents, by Wu and Manber's multi-pattern search over words.

Patterns are windows of benchmark words. For patterns of one length, a table tells for each block
of two words how far the search may jump when the block ends the part under view; blocks that end
a pattern allow no jump and name the patterns to compare directly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.frames import add_columns, ship, unused
from staylens.llm.words import byte_texts, words
from staylens.sources.durable import durable, release

WINDOW_WORDS = 10
# Benchmark bytes whose tables are broadcast at once; a larger benchmark is searched in parts.
PART_BYTES = 1 << 20


class LengthTables:
    """Shift table and buckets for patterns of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.furthest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        # Block at the end of a pattern -> the pattern's first word -> patterns and their items.
        self.buckets: dict[tuple[bytes, ...], dict[bytes, dict[tuple[bytes, ...], set[str]]]] = {}

    def add(self, pattern: tuple[bytes, ...], item: str | None) -> None:
        for end in range(self.block, self.length + 1):
            block = pattern[end - self.block : end]
            jump = self.length - end
            if jump < self.shift.get(block, self.furthest):
                self.shift[block] = jump
        bucket = self.buckets.setdefault(pattern[-self.block :], {})
        names = bucket.setdefault(pattern[0], {}).setdefault(pattern, set())
        if item is not None:
            names.add(item)

    def search(self, text: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        length, shift, furthest = self.length, self.shift, self.furthest
        two = self.block == 2
        last, size = length - 1, len(text)
        while last < size:
            block = (text[last - 1], text[last]) if two else (text[last],)
            jump = shift.get(block, furthest)
            if jump:
                last += jump
                continue
            start = last - length + 1
            candidates = self.buckets[block].get(text[start])
            if candidates:
                under_view = tuple(text[start : last + 1])
                for pattern, names in candidates.items():
                    if pattern == under_view:
                        spans.append((start, last + 1))
                        items |= names
            last += 1


class Tables:
    """The tables of all lengths for one part of a benchmark."""

    def __init__(self, benchmark: list[tuple[str | None, bytes]], window: int):
        self.by_length: dict[int, LengthTables] = {}
        for item, text in benchmark:
            found = tuple(words(text))
            length = min(window, len(found))
            if not length:
                continue
            tables = self.by_length.setdefault(length, LengthTables(length))
            for start in range(len(found) - length + 1):
                tables.add(found[start : start + length], item)

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Where patterns occur (start and end in words), and the items they belong to."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for tables in self.by_length.values():
            tables.search(text, spans, items)
        return spans, items


def merge_spans(spans: list[tuple[int, int]]) -> list[int]:
    """Flat starts and ends of the union of half-open spans; those that touch become one."""
    merged: list[int] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged


def find_passages(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW_WORDS,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (default: all), ``n_words``, ``hit_spans`` and ``hit_items`` of each row.

    ``hit_spans`` has the start and end (exclusive, in words) of each maximal run of hit words,
    flat; ``hit_items`` the distinct ids of benchmark items with an occurring window, as strings.
    An item of fewer than ``window`` words, but not none, is one window. Null texts have no words;
    benchmark rows without words have no windows, those without an id have windows but no name in
    ``hit_items``; repeated rows change nothing.

    The benchmark's size is checked first: each part of at most about ``PART_BYTES`` is broadcast and
    searched in a pass of its own, so memory does not grow with the benchmark. All passes but the last
    store what they find by the text's digest, never texts; documents are joined with that, and are
    not shuffled at all if there is one part.
    """
    items = benchmark.where("text is not null").select(
        F.col("item_id").cast("string").alias("item"), "text"
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    keep = documents.columns if keep is None else keep
    keep = [c for c in keep if c.lower() not in {"n_words", "hit_spans", "hit_items"}]
    spans, names = unused(documents, "_hit_spans"), unused(documents, "_hit_items")
    none = {spans: F.array().cast("array<int>"), names: F.array().cast("array<string>")}

    def tables(part: int) -> Tables:
        chosen = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).distinct()
        return Tables([(r["item"], r["text"].encode()) for r in chosen.collect()], window)

    if parts == 1:
        return _search(documents.withColumns(none), tables(0), text, [spans, names], keep)
    digest = unused(documents, "_digest")
    digests = F.unhex(F.sha2(F.col(text), 256))
    texts = documents.select(digests.alias("digest"), F.col(text).alias("text")).withColumns(none)
    steps = []
    for part in range(parts - 1):
        step = _search(texts, tables(part), "text", [spans, names], ["digest"])
        steps.append(durable(step.where(F.size("hit_spans") > 0).drop("n_words").dropDuplicates(["digest"])))
    merged = durable(
        reduce(DataFrame.unionByName, steps).groupBy(F.col("digest").alias(digest)).agg(
            F.flatten(F.collect_list("hit_spans")).alias(spans),
            F.array_distinct(F.flatten(F.collect_list("hit_items"))).alias(names),
        )
    )
    release(*steps)
    known = documents.join(merged, digests == F.col(digest), "left")
    known = known.withColumns({c: F.coalesce(c, empty) for c, empty in none.items()})
    return _search(known, tables(parts - 1), text, [spans, names], keep)


def _search(found: DataFrame, tables: Tables, text: str, earlier: list[str], keep: list[str]) -> DataFrame:
    """Adds the findings of one part to those of the columns ``earlier``."""
    shared = ship(found.sparkSession, tables)

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            counts, all_spans, all_items = [], [], []
            earlier = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for value, (flat, names) in zip(byte_texts(batch.column(0)), earlier, strict=True):
                found_words = words(value or b"")
                spans, items = shared().search(found_words)
                spans += zip(flat[::2], flat[1::2], strict=True)
                counts.append(len(found_words))
                all_spans.append(merge_spans(spans))
                all_items.append(sorted(items.union(names)))
            return {
                "n_words": pa.array(counts, pa.int64()),
                "hit_spans": pa.array(all_spans, pa.list_(pa.int32())),
                "hit_items": pa.array(all_items, pa.list_(pa.string())),
            }

        return work

    added = "n_words long, hit_spans array<int>, hit_items array<string>"
    return add_columns(found, [text, *earlier], added, make, keep)


def hit_words(spans: str = "hit_spans"):
    """Column: how many words the spans cover."""
    odd = F.col(spans)
    ends = F.aggregate(F.filter(odd, lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x)
    starts = F.aggregate(F.filter(odd, lambda _, i: i % 2 == 0), F.lit(0).cast("long"), lambda a, x: a + x)
    return ends - starts
