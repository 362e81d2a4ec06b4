"""Ranked lexical search: the exact top documents of each query by inner products on ball trees.

A document is a sparse vector over the queries' terms, of whole-number weights; a query is the set of
its terms, so a score is an inner product. Each task builds ball trees over blocks of its documents:
a node has the centroid of its documents and, for each block of dimensions, the radius around it. By
Cauchy and Schwarz no document of the node scores above q.c + sum of |q| r over the blocks, rounded
up safely. Nodes are visited best first; a query drops a subtree whose bound is below the score of its
last result so far. Leaves are scored in 64-bit integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.frames import ship, slices
from staylens.llm.words import byte_texts, words
from staylens.sources.durable import durable, release

TOP = 10
# Bytes of queries that are searched in one pass over the documents.
PART_BYTES = 1 << 20
# Documents of one tree and of a leaf.
TREE_DOCUMENTS = 4096
LEAF_DOCUMENTS = 32
# Blocks of dimensions that have a radius each.
RADIUS_BLOCKS = 32
_EPS = float(np.finfo(np.float64).eps)
_NO_ID = np.iinfo(np.int64).max


# ---- scores


def term_weight(documents: int, holders: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * holders + 1)))


def length_norm(size: int, documents: int, total: int) -> int:
    return 100 - 90 + (90 * size * documents) // total


@dataclass
class Queries:
    """Term sets of the queries of a part, over one vocabulary; flat, a run of terms a query."""

    terms: np.ndarray
    starts: np.ndarray
    vocabulary: int

    @classmethod
    def of(cls, texts: list[bytes]) -> tuple[Queries, dict[bytes, int], list[int]]:
        """Also the vocabulary and the numbers of the texts that have terms."""
        numbers: dict[bytes, int] = {}
        flat: list[int] = []
        starts, kept = [], []
        for i, text in enumerate(texts):
            own = sorted({numbers.setdefault(word, len(numbers)) for word in words(text)})
            if own:
                starts.append(len(flat))
                kept.append(i)
                flat += own
        return cls(np.array(flat, np.int64), np.array(starts, np.int64), len(numbers)), numbers, kept

    def __len__(self) -> int:
        return len(self.starts)

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.terms)))

    def some(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and starts of these queries."""
        sizes = self.sizes()[chosen]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        places = np.arange(int(ends[-1])) - np.repeat(starts, sizes) + np.repeat(self.starts[chosen], sizes)
        return self.terms[places], starts

    def block_norms(self, blocks: int) -> np.ndarray:
        """Norm of each query within each block of dimensions."""
        owner = np.repeat(np.arange(len(self)), self.sizes())
        counts = np.bincount(owner * blocks + self.terms % blocks, minlength=len(self) * blocks)
        return np.sqrt(counts.reshape(len(self), blocks))


# ---- trees


class BallTree:
    """Documents as rows of terms and values, and a balanced tree of balls over them."""

    def __init__(self, owner: np.ndarray, terms: np.ndarray, values: np.ndarray, rows: int, vocabulary: int,
                 blocks: int = RADIUS_BLOCKS, leaf: int = LEAF_DOCUMENTS):
        self.rows, self.vocabulary, self.blocks = rows, vocabulary, blocks
        self.owner, self.terms, self.values = owner, terms, values
        self.block_of_term = np.arange(vocabulary) % blocks
        self.starts = np.searchsorted(owner, np.arange(rows + 1))
        # What a sum of this many products may be off by, relative to the norms; doubled twice over.
        self.slack = 4 * (vocabulary + 8) * _EPS
        self.nodes: list[tuple[np.ndarray, float, np.ndarray, int, int, np.ndarray | None]] = []
        if rows:
            self._build(np.arange(rows), leaf)

    def entries(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of these documents' entries, and the documents' numbers among these for each."""
        sizes = self.starts[documents + 1] - self.starts[documents]
        before = np.cumsum(sizes) - sizes
        places = np.arange(int(sizes.sum())) - np.repeat(before, sizes) + np.repeat(self.starts[documents], sizes)
        return places, np.repeat(np.arange(len(documents)), sizes)

    def _build(self, documents: np.ndarray, leaf: int) -> int:
        places, own = self.entries(documents)
        terms, values = self.terms[places], self.values[places].astype(np.float64)
        centroid = np.bincount(terms, values, self.vocabulary) / len(documents)
        # |d - c|^2 = |d|^2 - 2 d.c + |c|^2, by document and block of dimensions.
        cells = len(documents) * self.blocks
        block = own * self.blocks + self.block_of_term[terms]
        squares = np.bincount(block, values * values, cells).reshape(-1, self.blocks)
        products = np.bincount(block, values * centroid[terms], cells).reshape(-1, self.blocks)
        centre = np.bincount(self.block_of_term, centroid * centroid, self.blocks)
        apart = squares - 2 * products + centre + self.slack * (squares + 2 * np.abs(products) + centre)
        radius = np.sqrt(np.maximum(apart, 0).max(axis=0)) * (1 + 8 * _EPS)
        number = len(self.nodes)
        size = float(np.sqrt((centroid * centroid).sum()))
        self.nodes.append((centroid, size, radius, -1, -1, documents))
        if len(documents) > leaf:
            far = self._furthest(apart.sum(axis=1), documents, places, own)
            order = np.argsort(far, kind="stable")
            half = len(documents) // 2
            left = self._build(np.sort(documents[order[:half]]), leaf)
            right = self._build(np.sort(documents[order[half:]]), leaf)
            self.nodes[number] = (centroid, size, radius, left, right, None)
        return number

    def _furthest(self, apart: np.ndarray, documents: np.ndarray, places: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How much nearer each document is to one of two that are far apart than to the other."""
        first = self._distances(int(apart.argmax()), documents, places, own)
        return first - self._distances(int(first.argmax()), documents, places, own)

    def _distances(self, pole: int, documents: np.ndarray, places: np.ndarray, own: np.ndarray) -> np.ndarray:
        dense = np.zeros(self.vocabulary)
        span = slice(self.starts[documents[pole]], self.starts[documents[pole] + 1])
        dense[self.terms[span]] = self.values[span]
        values = self.values[places].astype(np.float64)
        return np.bincount(own, values * (values - 2 * dense[self.terms[places]]), len(documents))


class Results:
    """The best documents so far of each query: scores falling, equal ones by id, null ids last."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.scores = np.zeros((queries, top), np.int64)
        self.absent = np.ones((queries, top), bool)
        self.ids = np.full((queries, top), _NO_ID, np.int64)

    def least(self) -> np.ndarray:
        """What a document must reach to be a result: a score above 0 where there is room."""
        return np.maximum(self.scores[:, -1], 1)

    def add(self, chosen: np.ndarray, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        """``scores`` has a row for each chosen query and a column for each document."""
        better = (scores >= self.least()[chosen, None]).any(axis=1)
        chosen, scores = chosen[better], scores[better]
        if not len(chosen):
            return
        shape = scores.shape
        every = np.concatenate([self.scores[chosen], scores], axis=1)
        names = np.concatenate([self.ids[chosen], np.broadcast_to(ids, shape)], axis=1)
        nameless = np.concatenate([self.absent[chosen], np.broadcast_to(absent, shape)], axis=1)
        order = np.lexsort((names, nameless, -every), axis=1)[:, : self.top]
        self.scores[chosen] = np.take_along_axis(every, order, 1)
        self.ids[chosen] = np.take_along_axis(names, order, 1)
        self.absent[chosen] = np.take_along_axis(nameless, order, 1)


def search(tree: BallTree, queries: Queries, results: Results, ids: np.ndarray, absent: np.ndarray,
           stats: dict | None = None) -> None:
    """Adds the tree's documents to the results of all queries, nodes of the best bounds first."""
    if not len(queries) or not tree.rows:
        return
    norms = queries.block_norms(tree.blocks)
    lengths = np.sqrt(queries.sizes())

    def bounds(node: int, chosen: np.ndarray) -> np.ndarray:
        centroid, size, radius = tree.nodes[node][:3]
        terms, starts = queries.some(chosen)
        centre = np.add.reduceat(centroid[terms], starts)
        reach = norms[chosen] @ radius
        # Whole scores: rounding errors, and one more, rounded down.
        return np.floor((centre + reach) * (1 + tree.slack) + tree.slack * lengths[chosen] * size + 1)

    everyone = np.arange(len(queries))
    first = bounds(0, everyone)
    heap = [(-float(first.max()), 0, everyone, first)]
    while heap:
        _, node, chosen, reached = heapq.heappop(heap)
        alive = reached >= results.least()[chosen]
        chosen = chosen[alive]
        if not len(chosen):
            continue
        left, right, documents = tree.nodes[node][3:]
        if documents is None:
            for child in (left, right):
                reached = bounds(child, chosen)
                alive = reached >= results.least()[chosen]
                if alive.any():
                    # Best first: how far above what is needed the best query may come.
                    ahead = float((reached[alive] / results.least()[chosen[alive]]).max())
                    heapq.heappush(heap, (-ahead, child, chosen[alive], reached[alive]))
            continue
        places, own = tree.entries(documents)
        dense = np.zeros((tree.vocabulary, len(documents)), np.int64)
        dense[tree.terms[places], own] = tree.values[places]
        terms, starts = queries.some(chosen)
        scores = np.add.reduceat(dense[terms], starts, axis=0)
        if stats is not None:
            stats["scored"] = stats.get("scored", 0) + scores.size
        results.add(chosen, scores, ids[documents], absent[documents])


# ---- on Spark


def _term_vectors(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (terms) and ``terms``, ``tfs`` of the vocabulary's terms, for rows with terms."""
    shared = ship(documents.sparkSession, numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for part in slices(batches):
            rows, sizes, terms, counts = [], [], [], []
            for row, text in enumerate(byte_texts(part.column(1))):
                found = words(text or b"")
                if not found:
                    continue
                own = [x for x in map(known.get, found) if x is not None]
                each, n = np.unique(np.array(own, np.int32), return_counts=True)
                rows.append(row)
                sizes.append(len(found))
                terms.append(each)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows, pa.int32())), pa.array(sizes, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<long>"
    )


@dataclass
class _Scoring:
    """All that a task needs besides the documents; its size is that of a part of the queries."""

    queries: Queries
    weights: np.ndarray
    documents: int
    total: int
    top: int

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        results = Results(len(self.queries), self.top)
        held: list[pa.RecordBatch] = []
        rows = 0
        for part in slices(batches, TREE_DOCUMENTS):
            if rows + part.num_rows > TREE_DOCUMENTS:
                self._search(held, results)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
        self._search(held, results)
        query, place = np.nonzero(results.scores > 0)
        ids = pa.array(results.ids[query, place], mask=results.absent[query, place])
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), ids, pa.array(results.scores[query, place])],
            ["query", "doc_id", "score"],
        )

    def _search(self, held: list[pa.RecordBatch], results: Results) -> None:
        if not held or not len(self.queries):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        ids, sizes = table.column("doc_id").combine_chunks(), table.column("n").to_pylist()
        lists = table.column("terms").combine_chunks()
        terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tfs = table.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        norms = np.array([length_norm(n, self.documents, self.total) for n in sizes], np.int64)
        values = self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * norms[owner]))
        tree = BallTree(owner, terms, values, table.num_rows, self.queries.vocabulary)
        absent = ids.is_null().to_numpy(zero_copy_only=False)
        search(tree, self.queries, results, ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False), absent)


def rank_documents(documents: DataFrame, queries: DataFrame, top: int = TOP, query_id: str = "item_id") -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), ``doc_id`` and ``score``: the best documents of each query row.

    Terms are runs of digits, ASCII letters and characters beyond ASCII, A-Z lower-cased. Results
    have scores above 0, falling, equal ones by id, null ids last. Each row of the queries is a query,
    each row of the documents a document, whether ids repeat or are null; null texts have no terms,
    and queries without terms no results. Empty tables give no rows.

    Queries are searched in parts of about ``PART_BYTES``, each with a pass over all documents; a part's
    terms and their counts are what is broadcast and collected. A task returns ``top`` rows a query.
    """
    spark = documents.sparkSession
    given = queries.where("text is not null").select(F.col(query_id).alias("id"), "text")
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    found = []
    kind = given.schema["id"].dataType.simpleString()
    for part in range(parts):
        rows = given.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect()
        of, numbers, kept = Queries.of([r["text"].encode() for r in rows])
        vectors = durable(_term_vectors(documents, numbers))
        whole = vectors.agg(F.count("*"), F.sum("n")).first()
        holders = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(max(1, len(numbers)), np.int64)
        for r in holders:
            weights[r["term"]] = term_weight(whole[0], r["count"])
        shared = ship(spark, _Scoring(of, weights, whole[0], whole[1] or 0, top))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from shared().rows(batches)

        best = vectors.mapInArrow(run, "query int, doc_id long, score long")
        # Before the shuffle each task keeps the best of its own.
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = durable(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
        release(vectors)
        names = spark.createDataFrame(
            [(q, rows[i]["id"]) for q, i in enumerate(kept)], f"query int, `{query_id}` {kind}"
        )
        found.append(ranked.join(F.broadcast(names), "query").select(query_id, "rank", "doc_id", "score"))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result
