"""Comparison, value order, restaurants and posts."""

from __future__ import annotations

import datetime as dt
import random
import statistics
from decimal import Decimal

from staylens import fixed_values as fv
from staylens import schemas
from staylens.operators import compare, nearby
from staylens.operators.rooms import attach_rooms, explode_rooms

COLUMNS = (
    "source string, location string, name string, rating10 decimal(5,1), price_krw bigint, "
    "price_basis string, available boolean"
)
A, B, C = fv.TRIVAGO, fv.YANOLJA, fv.YEOGI


def listings(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_compare_with_hot_group(spark):
    chance = random.Random(1)
    rows = []
    for i in range(1500):
        place, source = ("서울", A) if i % 2 else (chance.choice("ab"), chance.choice([A, B]))
        rating = Decimal(chance.randrange(0, 101)) / 10 if i % 5 else None
        price = chance.choice([50000, chance.randrange(1, 99999)]) if i % 7 else None
        rows.append((source, place, f"n{i}", rating, price, None, chance.choice([True, False, None])))
    found = {(r.location, r.source): r for r in compare.compare_platforms(listings(spark, rows)).collect()}
    used = [r for r in rows if r[4] is not None and r[6] is not False]
    assert set(found) == {(r[1], r[0]) for r in used}
    for (place, source), r in found.items():
        mine = [u for u in used if (u[1], u[0]) == (place, source)]
        prices = [u[4] for u in mine]
        ratings = [float(u[3]) for u in mine if u[3] is not None]
        assert (r.n, r.min_price) == (len(mine), min(prices))
        assert r.median_price == statistics.median(prices)
        assert abs(r.avg_price - statistics.fmean(prices)) < 1e-6
        assert abs(r.avg_rating - statistics.fmean(ratings)) < 1e-9


def test_what_matches_as_a_lodging(spark):
    frame = listings(spark, [
        (A, "서울 강남", "Inn", None, 90, None, None), (B, "서울강남", "inn!", None, 70, None, None),
        (A, "서울", None, None, 1, None, None), (B, "서울", None, None, 2, None, None),
        (A, "서울", "---", None, 1, None, None), (B, "서울", "!!", None, 2, None, None),
        (A, None, "Inn", None, 1, None, None), (B, None, "Inn", None, 2, None, None),
    ])
    gaps = {(r.location, r.source, r.gap, r.n_platforms) for r in compare.price_gap(frame).collect()}
    assert gaps == {("서울 강남", A, 20, 2), ("서울 강남", B, 0, 2)}
    (row,) = compare.pivot_prices(frame, [A, B]).collect()
    assert (row.match_key, row.location, row[A], row[B]) == ("inn", "서울 강남", 90, 70)
    dated = frame.selectExpr("*", "CASE WHEN source = 'Trivago' THEN 1 ELSE 2 END AS check_in")
    assert {r.check_in for r in compare.match_lodgings(dated, ["check_in"]).collect()} == {1, 2}


def test_gap_and_pivot(spark):
    frame = listings(spark, [
        (A, "서울", "Hotel A", None, 90, None, None),
        (B, "서울", "hotel-a", None, 70, "1박 기준", True),
        (B, "서울", "hotel a", None, 60, "1박 기준", False),
        (C, "서울", "HOTEL A!", None, 70, None, True),
        (A, "부산", "Hotel A", None, 10, None, True),
        (C, "부산", "sold", None, None, None, True),
    ])
    gaps = {(r.match_key, r.location, r.source): r for r in compare.price_gap(frame).collect()}
    assert len(gaps) == 4
    seoul = gaps["hotela", "서울", A]
    assert (seoul.cheapest_source, seoul.gap, seoul.n_platforms, seoul.mixed_basis) == (B, 20, 3, True)
    assert gaps["hotela", "서울", C].gap == 0
    assert not gaps["hotela", "부산", A].mixed_basis
    wide = {r.location: r for r in compare.pivot_prices(frame, [A, B, C]).collect()}
    assert (wide["서울"][A], wide["서울"][B], wide["서울"][C]) == (90, 70, 70)
    assert (wide["부산"][A], wide["부산"][B]) == (10, None)


def test_value_rank_and_topk(spark):
    rows = [
        (A, "서울", "good", Decimal("9.0"), 30000, None, True),
        (B, "서울", "same score, dearer", Decimal("9.0"), 30000, None, True),
        (A, "서울", "poor", Decimal("3.0"), 90000, None, True),
        (A, "서울", "free", Decimal("9.0"), 0, None, True),
        (A, "서울", "unrated", None, 20000, None, True),
        (A, "부산", "only", Decimal("5.0"), 10000, None, True),
    ]
    frame = listings(spark, rows)
    per = {r.name: r.value_rank for r in compare.value_rank(frame, ["location"]).collect()}
    assert per == {"good": 1, "same score, dearer": 2, "poor": 3, "free": 4, "unrated": 5, "only": 1}
    overall = {r.name: r.value_rank for r in compare.value_rank(frame).collect()}
    assert overall == {"only": 1, "good": 2, "same score, dearer": 3, "poor": 4, "free": 5, "unrated": 6}
    top = compare.top_value(frame, 2).collect()
    assert {(r.name, r.value_rank) for r in top} == {("good", 1), ("same score, dearer", 2), ("only", 1)}


def test_near(spark):
    frame = listings(spark, [
        (A, "서울", "h1", None, 1, None, True), (B, "서울", "h1", None, 1, None, True),
        (B, "서 울", "h2", None, 1, None, True), (B, "제주", "h3", None, 1, None, True)])
    places = spark.createDataFrame([
        ("p1", "국밥", "한식", "서울"), ("p2", "초밥", "일식", "서울"), ("p3", "카페", "other", "서울"),
        ("p4", "짜장", "중식", "부산")], schemas.PLACES)
    found = {r.place_id: r.n_lodgings for r in nearby.near_restaurants(frame, places).collect()}
    assert found == {"p1": 2, "p2": 2}
    assert nearby.near_restaurants(frame, places, lodging="H3").count() == 0
    assert nearby.near_restaurants(frame, places, ["한식"], lodging="h2").count() == 1
    counts = {r.name: (r["near_한식"], r["near_중식"]) for r in
              nearby.near_cuisine_counts(frame, places).collect()}
    assert counts == {"h1": (1, 0), "h2": (1, 0), "h3": (0, 0)}


def test_posts(spark):
    def at(*parts):
        return dt.datetime(*parts)

    posts = spark.createDataFrame([
        ("1", "부산", at(2025, 8, 1, 10), "t", "바다 축제"), ("2", "부산", at(2025, 8, 1, 23, 59), "t", "축제!"),
        ("3", "부산", at(2025, 12, 31, 23, 59, 59), "t", "축제"), ("4", "부산", at(2026, 1, 1), "t", "축제"),
        ("5", "서울", at(2025, 8, 1), "t", "축제"), ("6", "부산", at(2025, 8, 2), "t", "맛집")], schemas.POSTS)
    days = nearby.festival_by_date(posts, "부산").orderBy("posted_on").collect()
    assert [(r.posted_on, r.n) for r in days] == [(dt.date(2025, 8, 1), 2), (dt.date(2025, 12, 31), 1)]
    assert days[0].first_at == at(2025, 8, 1, 10) and days[0].last_at == at(2025, 8, 1, 23, 59)
    assert nearby.festival_posts(posts).count() == 4


def test_rooms_from_a_table_equal_rooms_from_an_array(spark):
    chance = random.Random(4)
    nested = []
    for i in range(200):
        n = 150 if i == 7 else chance.randrange(0, 4)
        rooms = [(chance.choice([None, "", "4인", "더블"]), chance.choice([[], ["문의"], ["5,000원"]]))
                 for _ in range(n)]
        nested.append((i, rooms, chance.choice([None, ["9,000원"]]), [chance.choice(["매진", "판매가", "가능"])]))
    frame = spark.createDataFrame(
        nested, "id int, rooms array<struct<description: string, prices: array<string>>>, "
        "prices array<string>, status_texts array<string>")
    flat = spark.createDataFrame(
        [(i, d, p) for i, rooms, *_ in nested for d, p in rooms], "id int, description string, prices array<string>")
    by_array = explode_rooms(frame).drop("room_pos")
    by_join = attach_rooms(frame.drop("rooms"), flat, "id")
    assert sorted(map(repr, map(tuple, by_array.select(by_join.columns).collect()))) == sorted(
        map(repr, map(tuple, by_join.collect())))
