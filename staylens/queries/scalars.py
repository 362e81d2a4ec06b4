"""Queries that run one function over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.functions import (
    availability as bookable,
    capacity as capacity_class,
    capacity_n,
    int_or,
    korean_date,
    months_ahead,
    nights,
    output_key,
    price_basis,
    price_digits,
    price_first,
    price_joined,
    price_krw as krw,
    price_per_night,
    price_won as won,
    rating10 as on_ten,
    rating_x2 as doubled,
    request_from_url,
    room_type as room_name,
    search_url,
    stay_date,
    strip,
)
from staylens.queries import query, table

_SPACES = fv.WHITESPACE.replace("'", "''")
_LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

# Prices as text, some without a number, some with another number first, some a lone comma.
_PRICE_TEXT_SQL = """
    WITH prices AS (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 5 AS kind,
               format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) AS amount
        FROM lineitem),
    texts AS (
        SELECT *, CASE kind WHEN 0 THEN '무료' WHEN 1 THEN '약 ' || amount || ' 원'
                            WHEN 2 THEN ',' WHEN 3 THEN '10% ' || amount || '원'
                            ELSE amount END AS text
        FROM prices)"""


def _price_texts(spark: SparkSession, folder: str) -> DataFrame:
    amount = F.format_number(F.floor("l_extendedprice"), 0)
    kind = F.col("l_suppkey") % 5
    text = (
        F.when(kind == 0, "무료")
        .when(kind == 1, F.concat(F.lit("약 "), amount, F.lit(" 원")))
        .when(kind == 2, ",")
        .when(kind == 3, F.concat(F.lit("10% "), amount, F.lit("원")))
        .otherwise(amount)
    )
    return table(spark, folder, "lineitem").select(*_LINE_KEYS, text.alias("text"))


@query(
    _PRICE_TEXT_SQL
    + f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE kind WHEN 0 THEN '{fv.NO_PRICE}' WHEN 2 THEN ',원' WHEN 3 THEN '10원'
                     ELSE amount || '원' END AS price
    FROM texts"""
)
def price_won(spark: SparkSession, folder: str) -> DataFrame:
    """First number of a text with the won sign."""
    price = F.coalesce(won("text"), F.lit(fv.NO_PRICE))
    return _price_texts(spark, folder).select(*_LINE_KEYS, price.alias("price"))


@query(
    _PRICE_TEXT_SQL
    + """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN kind IN (1, 3, 4) THEN CAST(replace(amount, ',', '') AS BIGINT) END
               AS price_krw
    FROM texts"""
)
def price_krw(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric price of every text form."""
    return _price_texts(spark, folder).select(*_LINE_KEYS, krw("text").alias("price_krw"))


@query(
    _PRICE_TEXT_SQL
    + f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN kind = 3 THEN '10' WHEN kind IN (1, 4) THEN replace(amount, ',', '')
                WHEN l_linenumber % 2 = 0 THEN '77' ELSE '{fv.NO_PRICE}' END AS price,
           CASE WHEN kind IN (1, 3, 4) THEN CAST(replace(amount, ',', '') AS BIGINT)
                WHEN l_linenumber % 2 = 0 THEN 77 END AS price_krw
    FROM texts"""
)
def price_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """First candidate text that gives a price; some rows have a second candidate that does."""
    second = F.when(F.col("l_linenumber") % 2 == 0, "77 원").otherwise("문의")
    texts = F.array("text", second)
    price = F.coalesce(price_digits(texts), F.lit(fv.NO_PRICE))
    return _price_texts(spark, folder).select(
        *_LINE_KEYS, price.alias("price"), price_first(texts).alias("price_krw")
    )


@query(
    """
    SELECT p_partkey, format('{:,}', CAST(floor(p_retailprice * 100) AS BIGINT)) || '원/1박'
               AS price
    FROM part"""
)
def span_join(spark: SparkSession, folder: str) -> DataFrame:
    """Price put together from the parts of a price block."""
    amount = F.format_number(F.floor(F.col("p_retailprice") * 100), 0)
    parts = F.array(F.concat(F.lit(" "), amount), F.lit("　원"), F.lit("/1박\n"))
    return table(spark, folder, "part").select("p_partkey", price_joined(parts).alias("price"))


_RATINGS_SQL = """
    WITH ratings AS (
        SELECT p_partkey, p_size,
               CASE WHEN p_partkey % 11 = 0 THEN NULL
                    WHEN p_partkey % 7 = 0 THEN CAST(p_size // 10 AS VARCHAR)
                    ELSE (p_size // 10) || '.' || (p_size % 10) END AS rating
        FROM part)"""


def _ratings(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.floor(F.col("p_size") / 10).cast("string")
    tenths = (F.col("p_size") % 10).cast("string")
    rating = (
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None))
        .when(F.col("p_partkey") % 7 == 0, whole)
        .otherwise(F.concat(whole, F.lit("."), tenths))
    )
    return table(spark, folder, "part").select("p_partkey", rating.alias("rating"))


@query(
    _RATINGS_SQL
    + f"""
    SELECT p_partkey,
           CASE WHEN rating IS NULL THEN '{fv.SENTINELS[fv.YANOLJA]["rating_raw"]}'
                WHEN p_partkey % 7 = 0 THEN rating
                ELSE (2 * p_size // 10) || '.' || (2 * p_size % 10) END AS rating
    FROM ratings"""
)
def rating_x2(spark: SparkSession, folder: str) -> DataFrame:
    """Rating text on a scale of ten; texts without a decimal point are kept."""
    default = F.lit(fv.SENTINELS[fv.YANOLJA]["rating_raw"])
    return _ratings(spark, folder).select(
        "p_partkey", F.coalesce(doubled("rating"), default).alias("rating")
    )


@query(
    _RATINGS_SQL
    + """
    SELECT p_partkey, round(CAST(rating AS DOUBLE) * 2, 1) AS doubled,
           CAST(rating AS DOUBLE) AS plain
    FROM ratings"""
)
def rating10(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric rating on a scale of ten, from a platform that rates out of five and one of ten."""
    return _ratings(spark, folder).select(
        "p_partkey",
        on_ten("rating", F.lit(fv.YANOLJA)).cast("double").alias("doubled"),
        on_ten("rating", F.lit(fv.TRIVAGO)).cast("double").alias("plain"),
    )


_CAPACITY_CASES = " ".join(
    "WHEN " + " OR ".join(f"contains(text, '{word}')" for word in words) + f" THEN '{label}'"
    for label, words in fv.CAPACITY_WORDS
)


@query(
    f"""
    WITH rooms AS (
        SELECT p_partkey,
               CASE p_partkey % 8 WHEN 0 THEN '싱글' WHEN 1 THEN '디럭스 더블' WHEN 2 THEN '트리플'
                    WHEN 3 THEN '쿼드' WHEN 4 THEN p_name
                    ELSE p_size || '인 ' || p_name END AS text
        FROM part)
    SELECT p_partkey, text, CASE {_CAPACITY_CASES} ELSE '{fv.DEFAULT_CAPACITY}' END AS capacity,
           try_cast(nullif(regexp_extract(text, '([0-9]+)인', 1), '') AS INTEGER) AS capacity_n
    FROM rooms"""
)
def capacity(spark: SparkSession, folder: str) -> DataFrame:
    """Capacity class and number of guests of a room description."""
    kind = F.col("p_partkey") % 8
    text = (
        F.when(kind == 0, "싱글")
        .when(kind == 1, "디럭스 더블")
        .when(kind == 2, "트리플")
        .when(kind == 3, "쿼드")
        .when(kind == 4, F.col("p_name"))
        .otherwise(F.concat("p_size", F.lit("인 "), "p_name"))
    )
    return table(spark, folder, "part").select(
        "p_partkey",
        text.alias("text"),
        capacity_class(text).alias("capacity"),
        capacity_n(text).alias("capacity_n"),
    )


@query(
    f"""
    WITH rooms AS (
        SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN ''
                               ELSE p_name || ' 객실 ' || p_brand || ' ' || p_type || ' 오션뷰' END
                   AS text
        FROM part)
    SELECT p_partkey, CASE WHEN text = '' THEN '{fv.DEFAULT_ROOM}'
                           ELSE substring(text, 1, {fv.ROOM_TYPE_LENGTH}) END AS room_type
    FROM rooms"""
)
def room_type(spark: SparkSession, folder: str) -> DataFrame:
    """Room type of a description, cut to its first characters."""
    text = F.when(F.col("p_partkey") % 10 == 0, "").otherwise(
        F.concat("p_name", F.lit(" 객실 "), "p_brand", F.lit(" "), "p_type", F.lit(" 오션뷰"))
    )
    return table(spark, folder, "part").select("p_partkey", room_name(text).alias("room_type"))


_STATUS_SQL = """
    WITH listings AS (
        SELECT o_orderkey, o_orderkey % 3 > 0 AS has_rooms,
               CASE o_orderstatus WHEN 'P' THEN '오늘 매진' WHEN 'F' THEN '판매가 10%'
                    ELSE '예약 가능' END AS status
        FROM orders),
    flags AS (
        SELECT o_orderkey,
               has_rooms OR NOT (contains(status, '매진') OR contains(status, '판매가'))
                   AS available,
               has_rooms OR NOT contains(status, '매진') AS available_strict
        FROM listings)"""


@query(
    _STATUS_SQL
    + f"""
    SELECT o_orderkey, available, available_strict,
           CASE WHEN o_orderkey % 13 = 0 THEN '{fv.FAILED}' WHEN available THEN '{fv.PER_NIGHT}'
                ELSE '{fv.SOLD_OUT}' END AS price_basis
    FROM flags"""
)
def availability(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a listing can be booked, by its rooms and status texts, and what its price covers."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    rooms = F.when(key % 3 == 1, F.array(F.lit("room"))).when(
        key % 3 == 2, F.array(F.lit("room"), F.lit("suite"))
    )
    texts = F.array(
        F.when(status == "P", "오늘 매진").when(status == "F", "판매가 10%").otherwise("예약 가능")
    )
    can_book = bookable(rooms, texts)
    return table(spark, folder, "orders").select(
        "o_orderkey",
        can_book.alias("available"),
        bookable(rooms, texts, fv.SOLD_OUT_WORDS_STRICT).alias("available_strict"),
        price_basis(can_book, failed=key % 13 == 0).alias("price_basis"),
    )


@query(
    f"""
    SELECT doc_id, length(trim(text, '{_SPACES}')) AS n_chars,
           md5(trim(text, '{_SPACES}')) AS digest
    FROM documents"""
)
def strip_text(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with white space of every kind put around them and taken off again."""
    blanks = F.lit(" \t　\x1c")
    padded = F.concat(blanks, "text", F.lit("\n  "), blanks)
    stripped = strip(padded)
    return table(spark, folder, "documents").select(
        "doc_id", F.length(stripped).alias("n_chars"), F.md5(stripped).alias("digest")
    )


def _guests_text() -> Column:
    kind = F.col("o_orderkey") % 4
    return F.when(kind == 0, " 3 ").when(kind == 1, "").when(kind == 2, "-3").otherwise("x")


_REQUESTS_SQL = """
    WITH requests AS (
        SELECT o_orderkey, '부산 ' || o_orderpriority AS query,
               strftime(o_orderdate, '%Y-%m-%d') AS check_in,
               strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d') AS check_out,
               CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 2 END AS adults,
               o_orderkey % 9 + 1 AS page_no
        FROM orders)"""


@query(
    _REQUESTS_SQL
    + f"""
    SELECT o_orderkey, adults,
           '{fv.YEOGI_HOST}/domestic-accommodations?keyword=' || replace(query, ' ', '+')
               || '&checkIn=' || check_in || '&checkOut=' || check_out || '&personal=' || adults
               || '&freeForm=false&page=' || page_no AS url,
           CASE o_orderkey % 3 WHEN 0 THEN 'trivago_' || query || '.csv'
                WHEN 1 THEN 'yanolja_' || query || '.csv'
                ELSE replace(query, ' ', '_') || '_yeogi.csv' END AS file_name,
           query AS back_query, check_in AS back_check_in, check_out AS back_check_out,
           adults AS back_adults, CAST(page_no AS INTEGER) AS back_page_no
    FROM requests"""
)
def request_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Search address and file name of a request, and the request read back from the address."""
    source = F.get(
        F.array(F.lit(fv.TRIVAGO), F.lit(fv.YANOLJA), F.lit(fv.YEOGI)),
        (F.col("o_orderkey") % 3).cast("int"),
    )
    requests = table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.lit("부산 "), "o_orderpriority").alias("query"),
        F.to_date("o_orderdate").alias("check_in"),
        F.date_add("o_orderdate", 2).alias("check_out"),
        int_or(_guests_text()).alias("adults"),
        (F.col("o_orderkey") % 9 + 1).alias("page_no"),
        source.alias("source"),
    )
    addressed = requests.select(
        "o_orderkey",
        "adults",
        search_url("query", "check_in", "check_out", "adults", "page_no").alias("url"),
        output_key("query", "source").alias("file_name"),
    )
    return addressed.withColumn("back", request_from_url("url")).select(
        "o_orderkey",
        "adults",
        "url",
        "file_name",
        F.col("back.query").alias("back_query"),
        F.col("back.check_in").cast("string").alias("back_check_in"),
        F.col("back.check_out").cast("string").alias("back_check_out"),
        F.col("back.adults").alias("back_adults"),
        F.col("back.page_no").alias("back_page_no"),
    )


@query(
    """
    WITH stays AS (
        SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END
                   AS check_in,
               CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - 1 AS INTEGER) AS DATE)
                   AS check_out
        FROM orders)
    SELECT o_orderkey, CAST(check_in AS VARCHAR) AS check_in,
           year(check_in) || '년 ' || month(check_in) || '월 ' || day(check_in) || '일' AS label,
           greatest((year(check_in) - 1998) * 12 + month(check_in) - 1,
                    CASE WHEN check_in IS NULL THEN NULL ELSE 0 END) AS months,
           CASE WHEN check_out > check_in THEN date_diff('day', check_in, check_out) END AS nights,
           CASE WHEN check_out > check_in
                THEN o_totalprice / date_diff('day', check_in, check_out) END AS per_night
    FROM stays"""
)
def stay_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of a stay from text: label, months from a fixed day, nights, price per night."""
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 11 == 0, F.date_format(day, "yyyy/MM/dd"))
        .when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "yyyy-M-d"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    stays = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_totalprice",
        stay_date(text).alias("check_in"),
        F.date_add(day, (F.col("o_orderkey") % 5 - 1).cast("int")).alias("check_out"),
    )
    return stays.select(
        "o_orderkey",
        F.col("check_in").cast("string").alias("check_in"),
        korean_date("check_in").alias("label"),
        months_ahead("check_in", F.lit("1998-01-01").cast("date")).alias("months"),
        nights("check_in", "check_out").alias("nights"),
        price_per_night("o_totalprice", "check_in", "check_out").alias("per_night"),
    )
