"""Whole analyses on pages in the platforms' own markup.

An order stands in for a captured page of its customer's search, its lines for the listings, rooms
or keywords on it. The builders below write such pages as captures; everything after that is done by
the library on the pages' texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens import plans
from staylens.queries import query, table

GUESTS = ("싱글", "2인", "트리플", "4인", "5인", "6인", "넓은")

# Pages, and the lines on them in their order.
_LINES_SQL = """
    WITH pages AS (
        SELECT o_orderkey AS o, CAST(o_custkey AS VARCHAR) AS request_id,
               CAST(o_orderkey AS INTEGER) AS page_no, * FROM orders),
    lines AS (
        SELECT p.*, l_linenumber AS line, CAST(floor(l_extendedprice) AS BIGINT) AS price,
               l_partkey AS part, l_suppkey AS supp, p_name, p_type, p_brand, p_size,
               (p_size // 10) || '.' || (p_size % 10) AS rating,
               row_number() OVER (PARTITION BY o ORDER BY l_linenumber, floor(l_extendedprice),
                                  l_partkey, l_suppkey) - 1 AS pos
        FROM pages p JOIN lineitem ON l_orderkey = o JOIN part ON p_partkey = l_partkey)"""


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their lines as an array: an order's lines fit a page."""
    parts = table(spark, folder, "part").withColumnRenamed("p_partkey", "l_partkey")
    line = F.struct(
        F.col("l_linenumber").alias("line"),
        F.floor("l_extendedprice").alias("price"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        "p_name", "p_type", "p_brand", "p_size",
    )
    lines = table(spark, folder, "lineitem").join(parts, "l_partkey")
    by_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(line)).alias("lines")
    )
    none = F.array().cast(by_order.schema["lines"].dataType)
    return table(spark, folder, "orders").join(by_order, "o_orderkey", "left").withColumns(
        {"o": F.col("o_orderkey"), "lines": F.coalesce("lines", none)}
    )


def _captures(pages: DataFrame, source: Column, html: Column) -> DataFrame:
    return pages.select(
        source.alias("source"),
        F.col("o_custkey").cast("string").alias("request_id"),
        F.col("o").cast("int").alias("page_no"),
        F.col("o_orderdate").alias("captured_at"),
        F.lit("").alias("url"),
        html.alias("html"),
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _unless(absent: Column, *parts: Column | str) -> Column:
    return F.when(absent, "").otherwise(_text(*parts))


def _each(write) -> Column:
    """What ``write`` makes of each line of the page, one after the other."""
    return F.array_join(F.transform("lines", write), "")


def _rating(line: Column) -> Column:
    return _text(F.floor(line["p_size"] / 10), ".", line["p_size"] % 10)


# ---- cards


def card_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of cards with missing fields, pages without cards, and three forms of a last page."""
    o = F.col("o")

    def card(line: Column) -> Column:
        return _text(
            '<article data-testid="item"><p>새로운<br>',
            _unless((line["line"] == 3) & (o % 5 == 0), '<span itemprop="name">\n ', line["p_name"], " &amp; Co </span>"),
            '<button data-testid="distance-label-section"><i></i><span>', line["p_brand"], "</span></button>",
            _unless(line["part"] % 11 == 0, '<span itemprop="ratingValue">', _rating(line), "</span>"),
            _unless(line["p_size"] % 7 == 0, '<button data-testid="accommodation-type">', line["p_type"], "</button>"),
            _unless(
                line["supp"] % 6 == 0, '<div data-testid="recommended-price">특가 <b>',
                F.format_number(line["price"], 0), "</b>원 (10%)</div>",
            ),
            "</article>",
        )

    button = '<button data-testid="next-result-page" class="pager'
    next_page = (
        F.when(o % 8 == 3, f'{button} is-disabled">다음</button>')
        .when(o % 8 == 5, f'{button}" disabled>다음</button>')
        .when(o % 8 == 6, "").otherwise(f'{button}">다음</button>')
    )
    html = _text("<!DOCTYPE html><html><body>", _unless(o % 13 == 0, _each(card)), next_page, "</body></html>")
    return _captures(_pages(spark, folder), F.lit(fv.TRIVAGO), html)


@query(
    _LINES_SQL
    + f""",
    stops AS (
        SELECT request_id, min(o) FILTER (o % 13 = 0 OR o NOT IN (SELECT o FROM lines)) AS none,
               min(o) FILTER (o % 8 IN (3, 5, 6)) AS last FROM pages GROUP BY request_id)
    SELECT l.request_id, page_no,
           CAST(row_number() OVER (PARTITION BY o ORDER BY pos) - 1 AS INTEGER) AS item_pos,
           p_name || ' & Co' AS name, CASE WHEN p_size % 7 <> 0 THEN p_type END AS lodging_type,
           p_brand AS location, rating AS rating_raw, CAST(rating AS DOUBLE) AS rating10,
           CASE WHEN supp % 6 <> 0 THEN format('{{:,}}', price) || '{fv.WON}' END AS price_raw,
           CASE WHEN supp % 6 <> 0 THEN price END AS price_krw
    FROM lines l JOIN stops s ON s.request_id = l.request_id
    WHERE o < coalesce(none, o + 1) AND o <= coalesce(last, o)
          AND NOT (line = 3 AND o % 5 = 0) AND part % 11 <> 0"""
)
def platform_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Typed listings of the card platform, up to each request's last page."""
    found = plans.card_listings(card_captures(spark, folder))
    return found.select(
        "request_id", "page_no", "item_pos", "name", "lodging_type", "location", "rating_raw",
        F.col("rating10").cast("double").alias("rating10"), "price_raw", "price_krw",
    )


# ---- rooms


def room_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with one listing and its rooms, some of it missing, sold out or without prices."""
    o = F.col("o")
    price_class = '<span class="typography-subtitle-18-bold">'

    def room(line: Column) -> Column:
        guests = F.element_at(F.array(*map(F.lit, GUESTS)), (line["supp"] % 7 + 1).cast("int"))
        return _text(
            '<div class="flex flex-col gap-6 rounded-8 bg-fill-neutral-weak px-8 py-8">',
            _unless(
                line["line"] == 5,
                '<span class="line-clamp-1 text-start text-text-neutral-sub typography-body-12-regular">',
                line["p_name"], "\n ", line["p_type"], " <i>", line["p_brand"], "</i> ", guests, " 룸</span>",
            ),
            _unless(line["part"] % 3 == 0, price_class, F.format_number(line["price"], 0), "원</span>"),
            "</div>",
        )

    stars = (
        F.when(o % 7 == 2, "신규").when(o % 7 == 3, "4")
        .otherwise(_text(F.floor(o % 500 / 100), ".", F.lpad((o % 100).cast("string"), 2, "0")))
    )
    status = F.when(F.col("o_orderstatus") == "F", "<div><em>예약마감</em></div>").when(
        F.col("o_orderstatus") == "P", "<div><em>판매가 확인</em></div>"
    ).otherwise("")
    listing = _text(
        '<a href="https://place-site.yanolja.com/places/', o, '">',
        _unless(o % 17 == 0, '<p class="typography-subtitle-16-bold">호텔\n  <b>', F.col("o_orderpriority"), "</b> </p>"),
        '<p class="text-text-neutral-sub typography-body-12-regular">', F.col("o_orderstatus"), " 형</p>",
        '<span class="line-clamp-1 text-start">부산 \t', F.col("o_custkey"), "</span>",
        '<span class="typography-body-14-bold">', stars, "</span>",
        price_class, "할인</span>",
        _unless(o % 4 == 1, price_class, F.format_number(F.floor("o_totalprice"), 0), "원</span>"),
        status,
        _unless(o % 6 == 0, _each(room)),
        "</a>",
    )
    return _captures(_pages(spark, folder), F.lit(fv.YANOLJA), _unless(o % 10 == 9, listing))


@query(
    _LINES_SQL
    + f""",
    sections AS (
        SELECT *, line <> 5 AS is_room, CASE WHEN part % 3 <> 0 THEN price END AS own,
               ['{"','".join(GUESTS)}'][supp % 7 + 1] AS guests FROM lines WHERE o % 6 <> 0),
    listings AS (
        SELECT *, coalesce(CASE WHEN o % 4 <> 1 THEN CAST(floor(o_totalprice) AS BIGINT) END,
                           (SELECT min_by(own, pos) FROM sections s WHERE s.o = p.o AND own IS NOT NULL)) AS base,
               (2 * (o % 500) + 5) // 10 AS tenths
        FROM pages p WHERE o % 10 <> 9),
    rooms AS (
        SELECT o, CAST(row_number() OVER (PARTITION BY o ORDER BY pos) - 1 AS INTEGER) AS room_pos, own,
               p_name || ' ' || p_type || ' ' || p_brand || ' ' || guests || ' 룸' AS description, guests
        FROM sections WHERE is_room)
    SELECT request_id, page_no, 0 AS item_pos, coalesce(room_pos, 0) AS room_pos,
           CASE WHEN l.o % 17 <> 0 THEN '호텔 ' || o_orderpriority END AS name,
           o_orderstatus || ' 형' AS lodging_type, '부산 ' || o_custkey AS location,
           CASE l.o % 7 WHEN 2 THEN '신규' WHEN 3 THEN '4'
                ELSE (tenths // 10) || '.' || (tenths % 10) END AS rating_raw,
           CASE l.o % 7 WHEN 2 THEN NULL WHEN 3 THEN 8.0
                ELSE CAST(tenths AS DOUBLE) / 10 END AS rating10,
           CASE WHEN room_pos IS NULL AND o_orderstatus IN ('F', 'P') THEN '{fv.SOLD_OUT}'
                ELSE CAST(coalesce(own, base) AS VARCHAR) END AS price_raw,
           coalesce(own, base) AS price_krw,
           CASE WHEN room_pos IS NULL AND o_orderstatus IN ('F', 'P') THEN '{fv.SOLD_OUT}'
                ELSE '{fv.PER_NIGHT}' END AS price_basis,
           CASE WHEN room_pos IS NULL THEN '{fv.DEFAULT_ROOM}'
                ELSE substr(description, 1, {fv.ROOM_TYPE_LENGTH}) END AS room_type,
           CASE guests WHEN '싱글' THEN '1인실' WHEN '트리플' THEN '3인실' WHEN '4인' THEN '4인실'
                       WHEN '5인' THEN '5인실' WHEN '6인' THEN '6인실' ELSE '2인실' END AS capacity,
           CASE guests WHEN '2인' THEN 2 WHEN '4인' THEN 4 WHEN '5인' THEN 5 WHEN '6인' THEN 6 END AS capacity_n,
           room_pos IS NOT NULL OR o_orderstatus <> 'F' AS available,
           'https://place-site.yanolja.com/places/' || l.o AS link
    FROM listings l LEFT JOIN rooms r ON r.o = l.o"""
)
def platform_rooms(spark: SparkSession, folder: str) -> DataFrame:
    """Typed listings of the platform with rooms, one row per room."""
    found = plans.room_listings(room_captures(spark, folder)).drop("source")
    return found.withColumn("rating10", F.col("rating10").cast("double"))


# ---- parallel lists


def list_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of parallel lists; on some, the list of ratings is one short."""
    o = F.col("o")
    rated = F.slice("lines", F.lit(1), F.size("lines") - F.when((o % 9 == 4) & (F.size("lines") > 0), 1).otherwise(0))
    ratings = F.transform(
        rated, lambda line: _text('<div class="css-19f645y"><span class="css-9ml4lz">', _rating(line), "</span></div>")
    )
    html = _text(
        _each(lambda line: _text('<h3 class="gc-thumbnail-type-seller-card-title x">　', line["p_name"], " </h3>")),
        _each(lambda line: _text('<ul class="css-bl7zf6"><li>', line["p_type"], "</li><li>기타</li></ul>")),
        _each(lambda line: _text('<div class="css-19li9i9"><span>', line["p_brand"], "</span><i><span> 역 </span></i></div>")),
        F.array_join(ratings, ""),
        _each(lambda line: _text(
            '<div class="css-yeouz0"><span>', F.format_number(line["price"], 0), "</span><span> 원 </span>",
            _unless(line["supp"] % 2 == 0, "<span>/1박</span>"), "</div>",
        )),
        _each(lambda line: _text(
            '<a class="gc-thumbnail-type-seller-card"', _unless(line["part"] % 8 == 0, ' href="/place/', line["part"], '"'), "></a>",
        )),
    )
    return _captures(_pages(spark, folder), F.lit(fv.YEOGI), html)


@query(
    _LINES_SQL
    + f""",
    sized AS (
        SELECT p.o, p.request_id, count(line) - CASE WHEN p.o % 9 = 4 AND count(line) > 0 THEN 1 ELSE 0 END AS n
        FROM pages p LEFT JOIN lines l ON l.o = p.o GROUP BY p.o, p.request_id),
    stops AS (SELECT request_id, min(o) FILTER (n = 0) AS none FROM sized GROUP BY request_id)
    SELECT l.request_id, page_no, CAST(pos AS INTEGER) AS item_pos, p_name AS name, p_type AS lodging_type,
           p_brand || ' 역' AS location, rating AS rating_raw, CAST(rating AS DOUBLE) AS rating10,
           format('{{:,}}', price) || '{fv.WON}' || CASE WHEN supp % 2 <> 0 THEN '{fv.PER_NIGHT_SUFFIX}' ELSE '' END AS price_raw,
           price AS price_krw, CASE WHEN supp % 2 <> 0 THEN '{fv.PER_NIGHT}' END AS price_basis,
           CASE WHEN part % 8 <> 0 THEN '{fv.YEOGI_HOST}/place/' || part END AS link
    FROM lines l JOIN sized z ON z.o = l.o JOIN stops s ON s.request_id = l.request_id
    WHERE pos < n AND l.o < coalesce(none, l.o + 1)"""
)
def platform_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Typed listings of the platform read by position, up to each request's first empty page."""
    found = plans.list_listings(list_captures(spark, folder))
    return found.select(
        "request_id", "page_no", "item_pos", "name", "lodging_type", "location", "rating_raw",
        F.col("rating10").cast("double").alias("rating10"), "price_raw", "price_krw", "price_basis", "link",
    )


# ---- rankings


def keyword_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the keyword lists of the three platforms in turn; some keywords are blank."""
    o = F.col("o")
    word = lambda line: F.when(line["line"] == 2, " ").otherwise(F.split_part(line["p_name"], F.lit(" "), F.lit(1)))
    buttons = _each(lambda line: _text('<button data-testid="apd-destination-button"> ', word(line), "</button>"))
    spans = _each(lambda line: _text('<span class="x PopularSearchList_keyword__1LfLt">', word(line), "</span>"))
    links = _each(lambda line: _text(
        "<a>", word(line), _unless(line["line"] == 2, "\n <b>", line["p_brand"], "</b>"), "</a><b><a>아님</a></b>",
    ))
    section = '<section aria-label="인기 검색 키워드"><div class="css-grswmc">'
    third = _text(
        '<div class="css-grswmc"><a>밖</a></div>', section, links, "</div></section>", section, "<a>둘째</a></div></section>",
    )
    html = F.when(o % 3 == 0, buttons).when(o % 3 == 1, spans).otherwise(third)
    source = F.when(o % 3 == 0, fv.TRIVAGO).when(o % 3 == 1, fv.YANOLJA).otherwise(fv.YEOGI)
    return _captures(_pages(spark, folder), source, html)


@query(
    _LINES_SQL
    + f""",
    words AS (
        SELECT o, request_id, page_no, pos,
               split_part(p_name, ' ', 1) || CASE WHEN o % 3 = 2 THEN ' ' || p_brand ELSE '' END AS region
        FROM lines WHERE line <> 2),
    kept AS (
        SELECT * FROM words
        QUALIFY o % 3 <> 0 OR row_number() OVER (PARTITION BY o, region ORDER BY pos) = 1)
    SELECT CASE o % 3 WHEN 0 THEN '{fv.TRIVAGO}' WHEN 1 THEN '{fv.YANOLJA}' ELSE '{fv.YEOGI}' END AS source,
           request_id, page_no, row_number() OVER (PARTITION BY o ORDER BY pos) AS rank, region
    FROM kept"""
)
def platform_rankings(spark: SparkSession, folder: str) -> DataFrame:
    """Rankings of all three platforms' pages."""
    return plans.rankings(keyword_captures(spark, folder)).drop("captured_at")
