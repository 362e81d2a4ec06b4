"""Ranked search, mixing of sources and whitening against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.llm import lexical, mixing, whitening
from staylens.llm.queries import QUERIES, table
from tests.llm import brute
from tests.llm.conftest import COLUMNS, FOLDER
from tests.llm.test_scans import same

# ---- ranked search


def test_ranked_documents(spark, documents, result):
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    expected = brute.ranked(documents, items)
    assert len({row[0] for row in expected}) > 10
    same(result("op11_lexical"), expected)


ITEMS = [(1, "the line is in a long text"), (2, "MIT license, one two"), (None, "d e one"), (3, ""), (4, None),
         (5, "of of OF unknown"), (6, "unknown words only"), (7, "é 1–2 a b c d e f g h i j k l"), (7, "text x")]


@pytest.mark.parametrize(("part_bytes", "tree", "leaf"), [(1 << 20, 4096, 32), (20, 5, 1)])
def test_ranking_of_odd_rows(spark, odd, odd_rows, empty, monkeypatch, part_bytes, tree, leaf):
    monkeypatch.setattr(lexical, "PART_BYTES", part_bytes)
    monkeypatch.setattr(lexical, "TREE_DOCUMENTS", tree)
    monkeypatch.setattr(lexical, "LEAF_DOCUMENTS", leaf)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(lexical.rank_documents(odd, items).collect(), brute.ranked(odd_rows, ITEMS))
    same(lexical.rank_documents(odd, items, top=2).collect(), brute.ranked(odd_rows, ITEMS, 2))
    assert lexical.rank_documents(empty, items).collect() == []
    assert lexical.rank_documents(odd, items.limit(0)).collect() == []


def random_tree(rng, rows, vocabulary, leaf, blocks, groups=8):
    """Rows near a few centres, as texts of a few subjects are, some equal ones among them."""
    entries = []
    for row in range(rows):
        centre = rng.integers(groups)
        terms = np.unique((centre * 7 + rng.integers(0, 12, rng.integers(0, 10))) % vocabulary)
        entries += [(row, int(t), int(rng.integers(1, 10**9))) for t in terms]
    entries = np.array(entries, np.int64).reshape(-1, 3)
    return entries, lexical.BallTree(entries[:, 0], entries[:, 1], entries[:, 2], rows, vocabulary, blocks, leaf)


@pytest.mark.parametrize("blocks", [1, 8, 64])
def test_no_document_is_above_its_balls_bound(blocks):
    rng = np.random.default_rng(blocks)
    entries, tree = random_tree(rng, 300, 64, 4, blocks)
    dense = np.zeros((300, 64), np.int64)
    dense[entries[:, 0], entries[:, 1]] = entries[:, 2]
    queries, _, _ = lexical.Queries.of([b" ".join(b"t%d" % t for t in rng.choice(64, 6, False)) for _ in range(40)])
    under = [set(range(300))]
    for centroid, _, radius, left, right, documents in tree.nodes:
        assert (left < 0) == (documents is not None)
    below = lambda node: (
        list(tree.nodes[node][5]) if tree.nodes[node][5] is not None
        else below(tree.nodes[node][3]) + below(tree.nodes[node][4])
    )
    assert set(below(0)) == under[0]
    for node, (centroid, size, radius, *_) in enumerate(tree.nodes):
        for document in below(node):
            apart = (dense[document] - centroid) ** 2
            by_block = [apart[np.arange(64) % blocks == b].sum() for b in range(blocks)]
            assert (np.sqrt(by_block) <= radius).all()


def test_search_prunes_and_finds_what_scoring_all_finds():
    rng = np.random.default_rng(3)
    entries, tree = random_tree(rng, 4000, 64, 16, 32)
    dense = np.zeros((4000, 64), np.int64)
    dense[entries[:, 0], entries[:, 1]] = entries[:, 2]
    # Numbered as they stand, so term k is column k.
    _, numbers, _ = lexical.Queries.of([b" ".join(b"t%d" % t for t in range(64))])
    terms = [np.sort(rng.choice(64, rng.integers(1, 8), False)) for _ in range(30)]
    starts = np.cumsum([0, *map(len, terms[:-1])])
    queries = lexical.Queries(np.concatenate(terms), starts, 64)
    results, stats = lexical.Results(30, 10), {}
    ids = rng.permutation(4000).astype(np.int64)
    lexical.search(tree, queries, results, ids, np.zeros(4000, bool), stats)
    for q, own in enumerate(terms):
        scores = dense[:, own].sum(axis=1)
        order = np.lexsort((ids, -scores))[:10]
        best = [(s, i) for s, i in zip(scores[order].tolist(), ids[order].tolist(), strict=True) if s > 0]
        found = list(zip(results.scores[q].tolist(), results.ids[q].tolist(), strict=True))
        assert [f for f in found if f[0] > 0] == best
    assert stats["scored"] < 0.7 * 30 * 4000, stats


# ---- mixing


def words_of(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(rows, documents):
    """Rows (doc, size, source, source_size, target, rate, copies, taken) of documents (doc, text, source)."""
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((d, s, words_of(t)) for d, t, s in documents)
    sizes = defaultdict(list)
    for _, t, s in documents:
        sizes[s].append(words_of(t))
    targets = brute.mix_targets({s: sum(v) for s, v in sizes.items()})
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        assert r.source_size == sum(sizes[r.source])
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-12, abs_tol=1e-9)
    for source, own in by_source.items():
        assert abs(sum(r.taken for r in own) - targets[source]) <= max(sizes[source]) / 2 + 1
        total = sum(sizes[source])
        if not total:
            continue
        if targets[source] >= 3 * total * (1 - 1e-12):
            assert all(r.rate == 3 and r.copies == 3 for r in own if r.size)
            continue
        expected = brute.tilts(sizes[source], float(targets[source]))
        for r in own:
            if r.size:
                assert math.isclose(r.rate, expected[r.size], rel_tol=1e-3, abs_tol=1e-6), (source, r)


def test_mix_of_documents(spark):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, FOLDER, "documents").collect()]
    check_mix(mixing.mix(table(spark, FOLDER, "documents"), keep=["doc_id", "source"]).collect(), rows)


@pytest.fixture(scope="module")
def uneven():
    """A hot source, sources that are full at once or later, long texts, nulls and copies."""
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 5, 30])), "hot") for i in range(400)]
    rows += [(1000 + i, "a\tb\x0bc" * rng.randint(1, 40), f"s{i % 4}") for i in range(60)]
    rows += [(2000, "w " * 5000, "s1"), (2001, "one", "tiny"), (2002, None, "none"), (2003, "", "none"), (2004, "x y", None),
             (2004, "x y", None), (None, "a b c", None), (None, None, None), (2005, "w " * 300, "é"), (2006, "v " * 7, "\U0001f600")]
    return rows


def test_mix_of_uneven_sources_agrees_with_itself(spark, uneven):
    frame = spark.createDataFrame(uneven, "doc_id long, text string, source string")
    keep = ["doc_id", "source"]
    rows = mixing.mix(frame.repartition(7), keep=keep).collect()
    check_mix(rows, uneven)
    same(mixing.mix(frame.orderBy(F.desc("text")), keep=keep).collect(), rows)


def test_mix_of_odd_tables(spark, odd, odd_rows, empty):
    clashing = odd.withColumns({c: F.lit("x") for c in ("target", "copies", "turn", "id", "place", "n", "_source", "_size", "l")})
    rows = mixing.mix(clashing).collect()
    assert rows[0].l == "x" and rows[0].turn == "x" and rows[0].target == rows[0].target * 1.0
    check_mix(rows, [(d, t, None) for d, t in odd_rows])
    copies = mixing.repeated(mixing.mix(odd, keep=["doc_id", "text"])).collect()
    assert sum(words_of(r.text) for r in copies) == sum(r.taken for r in rows)
    assert mixing.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, None, "a", "b", 0), (2, " ", "a", None, 0)], COLUMNS)
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_mixing_uses_no_python(spark):
    plan = QUERIES["op12_mixing"](spark, FOLDER)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# ---- whitening


def check_whitened(rows, vectors, components=4):
    """Rows of ``by_component`` against numpy's eigenvectors; ``vectors`` are the usable rows (id, list)."""
    x = {}
    for vec, values in vectors:
        x.setdefault(vec, []).append([math.floor(256 * float(np.float32(v))) for v in values])
    distinct = sorted({tuple(v) for vs in x.values() for v in vs})
    n, sums = len(distinct), [sum(column) for column in zip(*distinct, strict=True)]
    centred = np.array([[float(v - s / n) for v, s in zip(row, sums, strict=True)] for row in distinct])
    covariance = centred.T @ centred / n
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    wanted = min(components, len(sums))
    assert Counter((r.vec_id, r.component) for r in rows) == Counter(
        (vec, c + 1) for vec, vs in x.items() for _ in vs for c in range(wanted))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error <= 1e-4
    signs = {}
    for r in rows:
        assert r.n == n
        k = r.component - 1
        deviations = {sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x[r.vec_id]}
        assert int(r.deviation) in deviations
        assert math.isclose(r.explained, values[k] / np.trace(covariance), rel_tol=1e-8, abs_tol=1e-12)
        if values[k] < 1e-9 * np.trace(covariance):
            assert r.whitened == 0
            continue
        own = [float((np.array(row) - np.array(sums) / n) @ vectors_[:, k] / np.sqrt(values[k])) for row in x[r.vec_id]]
        if len(own) == 1 and abs(own[0]) > 1e-6:
            sign = signs.setdefault(k, np.sign(own[0]) * np.sign(r.whitened))
            assert math.isclose(r.whitened, sign * own[0], rel_tol=1e-6, abs_tol=1e-8)


def test_whitened_table(spark, result):
    rows = [(r.vec_id, r.embedding) for r in table(spark, FOLDER, "embeddings").collect()]
    check_whitened(result("op13_whitening"), rows)


def whitened(spark, rows, **extra):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {c: F.lit("x") for c in ("x", "dims", "n", "whitened", "explained", "v", "part", "place")})
    return whitening.by_component(whitening.whiten(frame.repartition(3), **extra), ["vec_id"]).collect()


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(6)
    nan, inf = float("nan"), float("inf")
    good = [(i, v) for i, v in enumerate((rng.normal(size=(40, 6)) * [9, 5, 3, 2, 1, 0.1]).tolist())]
    good += [(100, good[0][1]), (None, good[1][1]), (0, good[0][1]), (101, [-0.0, 0.0, 1.0, 0.0, 0.0, 0.0]), (102, [1e5] * 6)]
    bad = [(200, None), (201, []), (202, [nan] + [1.0] * 5), (203, [inf] + [1.0] * 5), (204, [None] + [1.0] * 5), (205, [1.0, 2.0]),
           (None, None)]
    check_whitened(whitened(spark, good + bad), good)
    assert whitened(spark, bad[:5]) == [] and whitened(spark, []) == []
    check_whitened(whitened(spark, [(1, [1.0, 2.0]), (2, [2.0, 5.0]), (3, [0.0, 1.0])]), [(1, [1.0, 2.0]), (2, [2.0, 5.0]), (3, [0.0, 1.0])])
    one = whitened(spark, [(1, [1.0, 2.0])] * 3)
    assert {(r.component, r.whitened, r.explained, r.deviation, r.identity_error) for r in one} == {
        (c, 0.0, 0.0, 0, 0.0) for c in (1, 2)}
    huge = whitened(spark, [(1, [3e38, 1.0]), (2, [-3e38, 1.0])])
    assert {r.component for r in huge} == {1, 2} and {round(abs(r.whitened)) for r in huge if r.component == 1} == {1}


def test_whole_numbers_are_floors_and_equal_vectors_equal_bytes():
    import pyarrow as pa

    found = whitening.whole_vectors(pa.array([[-0.001, 0.0, -0.0, 1.999], None, [1e30, -1e30], [2.5, None]], pa.list_(pa.float32())))
    assert found[0].tolist() == [-1, 0, 0, 511] and found[1] is None and found[3] is None
    assert found[2].tolist() == [2**63 - 1, -(2**63)]
    for row in ([1, -2], [1, 40_000], [2**40, 0], [-(2**63), 2**63 - 1]):
        packed = whitening.pack(np.array(row, np.int64))
        assert whitening.unpack([packed], 2).tolist() == [row]


@pytest.mark.parametrize("kind", range(4))
def test_eigenpairs_of_random_and_degenerate_matrices(kind):
    rng = np.random.default_rng(kind)
    for _ in range(15):
        n = int(rng.integers(1, 30))
        if kind == 0:
            a = np.diag(rng.integers(0, 3, n).astype(float))
        elif kind == 1:  # few dimensions
            b = rng.normal(size=(n, max(1, n // 3)))
            a = b @ b.T
        elif kind == 2:  # three equal leading values
            q, _ = np.linalg.qr(rng.normal(size=(n, n)))
            a = q @ np.diag([*np.full(min(n, 3), 5.0), *rng.random(max(0, n - 3))]) @ q.T
            a = (a + a.T) / 2
        else:
            b = rng.normal(size=(n, n))
            a = b @ b.T * 1e6
        values, vectors = whitening.eigenpairs(a, 4)
        expected = np.linalg.eigvalsh(a)[::-1][:4]
        size = max(abs(expected).max(), 1e-300)
        assert np.allclose(values / size, expected / size, atol=1e-13)
        assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-9
        assert np.abs(a @ vectors.T - vectors.T * values).max() / size < 1e-11
