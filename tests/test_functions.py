"""Column functions: input and expected result, quirks included."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens import functions as fn


def values(spark, schema, rows, expression):
    frame = spark.createDataFrame([(i, row) for i, row in enumerate(rows)], f"i int, x {schema}")
    return [r[0] for r in frame.orderBy("i").select(expression.alias("y")).collect()]


CASES = {
    "price_digits": (
        "array<string>",
        lambda: fn.price_digits("x"),
        [
            (["54,000원"], "54000"),
            (["무료", ",", "54,000원"], "54000"),
            (["무료"], None),
            (["10% 54,000원"], "10"),
            (["５４,０００원"], "５４０００"),
            ([], None),
            (None, None),
        ],
    ),
    "price_won": (
        "string",
        lambda: fn.price_won("x"),
        [("약 54,000 원", "54,000원"), ("무료", None), (",", ",원"), ("", None), (None, None)],
    ),
    "price_joined": (
        "array<string>",
        lambda: fn.price_joined("x"),
        [(["54,000", "원", "/1박"], "54,000원/1박"), ([" 1 ", "박"], "1 박"), ([], "")],
    ),
    "price_krw": (
        "string",
        lambda: fn.price_krw("x"),
        [
            ("54,000원/1박", 54000),
            ("10% 54,000원", 54000),
            ("54000", 54000),
            ("５４,０００원", 54000),
            (",원", None),
            ("예약마감", None),
            (None, None),
        ],
    ),
    "rating_x2": (
        "string",
        lambda: fn.rating_x2("x"),
        [
            ("4.9", "9.8"), ("4.43", "8.9"), ("5", "5"), ("신규", "신규"), (None, None),
            ("평점 4.5점", "9.0"), ("４.５", "9.0"), ("", ""),
        ],
    ),
    "rating10_doubled": (
        "string",
        lambda: fn.rating10("x", F.lit(fv.YANOLJA)),
        [("4.9", Decimal("9.8")), ("5", Decimal("10.0")), ("신규", None), (None, None)],
    ),
    "rating10": (
        "string",
        lambda: fn.rating10("x", F.lit(fv.TRIVAGO)),
        [("8.7", Decimal("8.7")), ("9", Decimal("9.0")), (None, None)],
    ),
    "capacity": (
        "string",
        lambda: fn.capacity("x"),
        [
            ("디럭스 더블", "2인실"), ("싱글", "1인실"), ("2~4인", "4인실"),
            ("11인 도미토리", "1인실"), ("8인", "2인실"), ("16인", "6인실"), ("", "2인실"),
        ],
    ),
    "capacity_n": (
        "string",
        lambda: fn.capacity_n("x"),
        [("11인 도미토리", 11), ("2~4인", 4), ("더블", None), ("４인", 4)],
    ),
    "room_type": (
        "string",
        lambda: fn.room_type("x"),
        [("가" * 31, "가" * 30), ("가" * 30, "가" * 30), ("", "기본객실"), ("🏨" * 31, "🏨" * 30)],
    ),
    "int_or": (
        "string",
        lambda: fn.int_or("x"),
        [("3", 3), ("", 2), ("-3", 2), ("x", 2), (" 4 ", 4), (None, 2), ("３", 3)],
    ),
    "absolute_url": (
        "string",
        lambda: fn.absolute_url(fv.YEOGI_HOST, "x"),
        [
            ("/a", "https://www.yeogi.com/a"), ("", None), (None, None),
            ("https://h/b", "https://h/b"),
        ],
    ),
    "stay_date": (
        "string",
        lambda: fn.stay_date("x"),
        [
            ("2025-08-02", dt.date(2025, 8, 2)), ("2025-8-2", dt.date(2025, 8, 2)),
            ("2025-13-01", None), ("2025-02-30", None), ("2025-008-02", None), ("+12025-1-1", None),
            ("", None), (None, None),
        ],
    ),
    "korean_date": (
        "string",
        lambda: fn.korean_date(fn.stay_date("x")),
        [("2025-08-02", "2025년 8월 2일"), ("2025-12-31", "2025년 12월 31일")],
    ),
    "months_ahead": (
        "string",
        lambda: fn.months_ahead(fn.stay_date("x"), F.lit("2025-12-01").cast("date")),
        [("2026-01-31", 1), ("2025-12-31", 0), ("2025-01-01", 0), ("2027-02-01", 14), ("x", None)],
    ),
    "nights": (
        "string",
        lambda: fn.nights(F.lit("2025-08-02").cast("date"), fn.stay_date("x")),
        [("2025-08-04", 2), ("2025-08-02", None), ("2025-08-01", None)],
    ),
    "match_key": (
        "string",
        lambda: fn.match_key("x"),
        [("Hotel  A-1", "hotela1"), ("호텔·신라 (서울)", "호텔신라서울"), ("", ""), (None, None)],
    ),
    "has_match_key": (
        "string",
        lambda: fn.has_match_key("x"),
        [("Hotel", True), ("-·( 1", True), ("호텔", True), (" \u3000—!?", False), ("", False), (None, None)],
    ),
    "contains_any": (
        "string",
        lambda: fn.contains_any("x", fv.SOLD_OUT_WORDS),
        [("오늘 매진", True), ("판매가", True), ("예약 가능", False)],
    ),
    "output_key": (
        "string",
        lambda: fn.output_key(F.lit("부산 해운대"), "x"),
        [
            (fv.TRIVAGO, "trivago_부산 해운대.csv"),
            (fv.YANOLJA, "yanolja_부산 해운대.csv"),
            (fv.YEOGI, "부산_해운대_yeogi.csv"),
        ],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    schema, expression, cases = CASES[name]
    assert values(spark, schema, [c[0] for c in cases], expression()) == [c[1] for c in cases]


def test_strip_takes_the_same_characters_as_python(spark):
    texts = [f"{chr(c)} a{chr(c)}b {chr(c)}\n" for c in range(1, 0x3100) if chr(c).isspace()]
    texts += ["", " \t", "​a​", "a"]
    assert values(spark, "string", texts, fn.strip("x")) == [t.strip() for t in texts]


def test_availability(spark):
    rows = [
        ([], ["오늘 매진"]), (None, ["판매가 10%"]), (["r"], ["매진"]), ([], ["예약 가능"]), ([], None),
    ]
    frame = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "i int, rooms array<string>, texts array<string>"
    ).orderBy("i")
    loose = fn.availability("rooms", "texts")
    strict = fn.availability("rooms", "texts", fv.SOLD_OUT_WORDS_STRICT)
    found = frame.select(loose, strict, fn.price_basis(loose)).collect()
    assert [r[0] for r in found] == [False, False, True, True, True]
    assert [r[1] for r in found] == [False, True, True, True, True]
    assert [r[2] for r in found] == ["예약마감", "예약마감"] + ["1박 기준"] * 3


def test_search_url_and_back(spark):
    frame = spark.createDataFrame(
        [("부산 해운대", dt.date(2025, 8, 2), dt.date(2025, 8, 4), 2, 3)],
        "q string, a date, b date, n int, p int",
    )
    plain = fn.search_url("q", "a", "b", "n", "p")
    safe = fn.search_url("q", "a", "b", "n", "p", encode=True)
    row = frame.select(
        plain.alias("url"), fn.request_from_url(plain).alias("r"), fn.request_from_url(safe).alias("s")
    ).first()
    assert row.url == (
        "https://www.yeogi.com/domestic-accommodations?keyword=부산+해운대&checkIn=2025-08-02"
        "&checkOut=2025-08-04&personal=2&freeForm=false&page=3"
    )
    for back in (row.r, row.s):
        assert tuple(back) == ("부산 해운대", dt.date(2025, 8, 2), dt.date(2025, 8, 4), 2, 3)


def test_url_parameters_that_are_not(spark):
    urls = ["http://h/a&page=1", "http://h/#x?page=2", "http://h/?subpage=3", "http://h/?page=%zz",
            "http://h/?a=?&page=5&page=6"]
    got = values(spark, "string", urls, fn.request_from_url("x")["page_no"])
    assert got == [None, None, None, None, 5]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**15), min_size=1, max_size=20))
def test_formatted_prices_come_back(spark, numbers):
    texts = [[f"약 {n:,} 원"] for n in numbers]
    assert values(spark, "array<string>", texts, fn.price_digits("x")) == [str(n) for n in numbers]
    assert values(spark, "string", [t[0] for t in texts], fn.price_krw("x")) == numbers


def test_ratings_round_as_formatted_floats(spark):
    texts = [f"{n / 100:.2f}" for n in range(0, 1001)]
    expected = [f"{float(t) * 2:.1f}" for t in texts]
    assert values(spark, "string", texts, fn.rating_x2("x")) == expected
