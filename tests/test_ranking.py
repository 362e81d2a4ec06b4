"""Rankings against plain Python, also with hot keys and any number of partitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.operators.ranking import (
    counts_by,
    distinct_first,
    order_key,
    rank_by_order,
    source_report,
    union_sources,
)


def keywords(seed=1, n=3000):
    """Half of the rows in one source, a third of the rows one keyword."""
    chance = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if chance.random() < 0.5 else chance.choice("abc")
        region = "서울" if chance.random() < 0.34 else f"r{chance.randrange(200)}"
        rows.append((source, region, i // 7, i % 7))
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_distinct_ranking(spark, partitions):
    rows = keywords()
    expected = set()
    for source in {r[0] for r in rows}:
        regions = dict.fromkeys(r[1] for r in rows if r[0] == source)
        expected |= {(source, region, rank) for rank, region in enumerate(regions, 1)}
    shuffled = random.Random(2).sample(rows, len(rows))
    frame = spark.createDataFrame(shuffled, "source string, region string, page int, pos int")
    placed = frame.repartition(partitions).select("source", "region", order_key("page", "pos").alias("k"))
    first = distinct_first(placed, ["source", "region"], "k")
    ranked = rank_by_order(first, ["source"], [F.col("first_pos")])
    assert {(r.source, r.region, r["rank"]) for r in ranked.collect()} == expected


def test_raw_ranking_spans_blocks(spark):
    rows = keywords(3)
    frame = spark.createDataFrame(rows, "source string, region string, page int, pos int")
    placed = frame.select("source", "page", "pos", order_key("page", "pos").alias("k"))
    ranked = rank_by_order(placed, ["source"], [F.col("k")]).collect()
    for source in {r[0] for r in rows}:
        mine = sorted((r.page, r.pos, r["rank"]) for r in ranked if r.source == source)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))


def test_a_null_key_is_ranked_too(spark):
    rows = [(None, 1), (None, 9), ("a", 5), (None, 4)]
    frame = spark.createDataFrame(rows, "source string, k bigint")
    ranked = rank_by_order(frame, ["source"], [F.col("k")]).collect()
    assert {tuple(r) for r in ranked} == {(None, 1, 1), (None, 4, 2), (None, 9, 3), ("a", 5, 1)}


def test_order_keys_of_any_page_number(spark):
    pages = [-(2**63), -1, 0, 5000, 10_000, 2**36, 2**40, 2**63 - 1]
    rows = [("s", page, pos) for page in pages for pos in (0, 1, 2**27, 2**31 - 1)]
    shuffled = random.Random(3).sample(rows, len(rows))
    frame = spark.createDataFrame(shuffled, "source string, page bigint, pos int")
    placed = frame.withColumn("k", order_key("page", "pos"))
    ranked = rank_by_order(placed, ["source"], [F.col("k")])
    assert dict(ranked.dtypes)["rank"] == "bigint"
    found = sorted(ranked.collect(), key=lambda r: r["rank"])
    assert [(r.page, r.pos) for r in found] == [row[1:] for row in rows]


@pytest.mark.parametrize("keys", [[], ["region"]])
def test_rank_by_order(spark, keys):
    chance = random.Random(5)
    rows = [
        ("hot" if i % 3 else chance.choice(["a", "b", None]), chance.choice([None, 1.0, 2.0]), i)
        for i in range(2000)
    ]
    frame = spark.createDataFrame(rows, "region string, score double, id int").repartition(6)
    order = [F.col("score").desc_nulls_last(), F.col("id").asc()]
    ranked = rank_by_order(frame, keys, order).collect()
    assert len(ranked) == len(rows)
    expected = {}
    groups = {r[0] for r in rows} if keys else {None}
    for group in groups:
        mine = [r for r in rows if not keys or r[0] == group]
        mine.sort(key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        expected.update({r[2]: rank for rank, r in enumerate(mine, 1)})
    assert {r.id: r["rank"] for r in ranked} == expected


def test_union_and_report(spark):
    frames = {
        name: spark.createDataFrame([(w,) for w in words], "region string")
        for name, words in ((fv.TRIVAGO, ["서울", "부산"]), (fv.YANOLJA, ["서울"]))
    }
    union = union_sources(frames)
    report = source_report(union, [fv.TRIVAGO, fv.YANOLJA, fv.YEOGI])
    assert {tuple(r) for r in report.collect()} == {
        (fv.TRIVAGO, 2, "ok"), (fv.YANOLJA, 1, "ok"), (fv.YEOGI, 0, "데이터 없음")}
    assert counts_by(union, []).first().n == 3
    assert {tuple(r) for r in counts_by(union, ["source"]).collect()} == {
        (fv.TRIVAGO, 2), (fv.YANOLJA, 1)}
