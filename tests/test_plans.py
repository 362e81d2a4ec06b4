"""Physical plans: what is pushed down, what is shuffled, how often a page is read."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from staylens.functions.markup import Field
from staylens.operators.compare import with_stays
from staylens.operators.extract import extract_aligned, extract_cards, extract_keywords
from staylens.operators.ranking import distinct_first
from staylens.plans import room_listings
from staylens.queries import QUERIES
from staylens.queries.pages import NAV_KEYWORDS, PAGE_CARD, placed_keywords
from staylens.specs import CardSpec, KeywordSpec, ListSpec

FOLDER = "/root/testdata/sf0.01"


def plan(frame):
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def count(text, node):
    return len(re.findall(rf"^\s*[:+\-* ]*{node} \(\d+\)", text, re.M))


def queries(spark, name):
    return plan(QUERIES[name](spark, FOLDER))


@pytest.fixture
def pages(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet").withColumnRenamed("page_id", "request_id")


def test_filters_pass_the_page_reader(pages):
    cards = extract_cards(pages, PAGE_CARD, ["request_id"]).filter("request_id = 5")
    text = plan(cards)
    assert "EqualTo(request_id,5)" in text or "EqualTo(page_id,5)" in text
    assert re.search(r"ReadSchema: struct<page_id:bigint,html:string>", text)


@pytest.mark.parametrize(
    "name", ["cards_required", "cards_optional", "aligned_lists", "rank_selector", "rooms_nested"]
)
def test_a_page_is_read_once(spark, name):
    text = queries(spark, name)
    assert count(text, "ArrowEvalPython") == 1
    assert count(text, "Exchange") == 0


def test_room_listings_read_a_page_once(spark):
    frame = spark.createDataFrame(
        [], "source string, request_id string, page_no int, html string")
    assert count(plan(room_listings(frame)), "ArrowEvalPython") <= 1
    spec = ListSpec("x", {"a": Field("a", many=True), "b": Field("b", many=True)})
    assert count(plan(extract_aligned(frame, spec)), "ArrowEvalPython") <= 1


def test_page_rankings_need_no_shuffle(spark, pages):
    for spec in (NAV_KEYWORDS, KeywordSpec("x", "nav a", distinct=True)):
        assert count(plan(extract_keywords(pages, spec, ["request_id"])), "Exchange") == 0
    assert "ArrowEvalPython" not in queries(spark, "rank_raw")


def test_dedup_aggregates_by_hash_before_the_shuffle(spark):
    placed = placed_keywords(spark, FOLDER)
    text = plan(distinct_first(placed, ["source", "region"], "place"))
    assert "SortAggregate" not in text
    assert count(text, "HashAggregate") == 2 and count(text, "Exchange") == 1


def test_ranking_over_pages_reads_them_once(spark):
    text = queries(spark, "rank_dedup")
    assert "html" not in text  # the ranking runs on the stored keywords
    assert count(text, "SortMergeJoin") + count(text, "BroadcastHashJoin") == 0


def test_topk_is_limited_before_the_shuffle(spark):
    text = queries(spark, "value_topk")
    assert count(text, "WindowGroupLimit") == 2


def test_scans_read_only_what_is_used(spark):
    text = queries(spark, "counts_total")
    assert "ReadSchema: struct<>" in text
    text = queries(spark, "platform_compare")
    assert "l_orderkey" not in text and "l_comment" not in text and "p_retailprice" not in text


def test_post_filters_reach_the_scan(spark):
    text = queries(spark, "posts_by_date")
    assert "GreaterThanOrEqual(ts," in text and "StringContains(event_type,signup)" in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_python(spark, name):
    text = queries(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert "SortAggregate" not in text


def test_rank_union_reads_pages_once_and_pivot_shuffles_once(spark):
    assert queries(spark, "source_report").count("ReadSchema: struct<url:string,html:string") <= 1
    pivot = QUERIES["platform_pivot"](spark, FOLDER)
    assert plan(pivot).count("hashpartitioning(match_key") == 1


UNREADABLE = "<p>a</p><![broken["


def test_unread_pages_are_counted_by_the_pass_that_reads(spark):
    pages = spark.createDataFrame(
        [("r", n, html) for n, html in enumerate(["<p>a</p><p>b</p>", UNREADABLE, None, "<i>"])],
        "request_id string, page_no int, html string")
    spec = ListSpec("x", {"a": Field("p", many=True)})
    seen = Observation()
    listed = extract_aligned(pages, spec, ["page_no"], seen)
    assert count(plan(listed), "ArrowEvalPython") == 1
    assert sorted(r.a for r in listed.collect()) == ["a", "b"]
    assert seen.get == {"pages": 4, "unread": 1}
    seen = Observation()
    cards = extract_cards(pages, CardSpec("x", "p", {"a": Field("")}), ["page_no"], observation=seen)
    assert count(plan(cards), "ArrowEvalPython") == 1
    assert len(cards.collect()) == 2 and seen.get == {"pages": 4, "unread": 1}


def test_a_hot_request_is_split_in_the_join_with_its_stay(spark):
    """A request with most of the listings: the join's tasks share it, as the executed plan says."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 50))
        listings = spark.range(40_000).repartition(8).select(
            hot.alias("request_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("name"),
            F.col("id").alias("price_krw"), F.lit(None).cast("string").alias("price_basis"))
        requests = listings.select("request_id", "source").distinct().selectExpr(
            "*", "date'2025-08-01' AS check_in", "date'2025-08-03' AS check_out")
        joined = with_stays(listings, requests)
        assert joined.where("per_night = price_krw / 2").count() == 40_000
        joined.collect()
        executed = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in executed
    finally:
        for key in settings:
            spark.conf.unset(key)
