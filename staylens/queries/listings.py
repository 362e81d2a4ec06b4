"""Queries that build listings: rooms, unions, the files' view, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.operators.listings import compat_view, union_listings
from staylens.operators.ranking import counts_by
from staylens.operators.rooms import attach_rooms
from staylens.queries import query, table

_STATUS_SQL = """CASE o_orderstatus WHEN 'P' THEN '오늘 매진' WHEN 'F' THEN '판매가 10%'
                 ELSE '예약 가능' END"""


@query(
    f"""
    WITH listings AS (
        SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS base, {_STATUS_SQL} AS status
        FROM orders),
    rooms AS (
        SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS guests,
               CASE WHEN l_linenumber % 3 <> 0 THEN CAST(floor(l_extendedprice) AS BIGINT) END
                   AS own
        FROM lineitem),
    joined AS (
        SELECT o_orderkey, l_linenumber AS room_no,
               CASE WHEN guests IS NULL THEN '{fv.DEFAULT_ROOM}' ELSE guests || '인 객실' END
                   AS room_type,
               CASE WHEN guests IS NULL THEN '{fv.DEFAULT_CAPACITY}'
                    WHEN guests % 10 BETWEEN 1 AND 6 THEN (guests % 10) || '인실'
                    ELSE '{fv.DEFAULT_CAPACITY}' END AS capacity,
               guests AS capacity_n,
               guests IS NULL AND (contains(status, '매진') OR contains(status, '판매가'))
                   AS sold_out,
               guests IS NOT NULL OR NOT contains(status, '매진') AS available,
               coalesce(own, base) AS price_krw
        FROM listings LEFT JOIN rooms ON l_orderkey = o_orderkey)
    SELECT o_orderkey, room_no, room_type, capacity, capacity_n,
           CASE WHEN sold_out THEN '{fv.SOLD_OUT}' ELSE CAST(price_krw AS VARCHAR) END
               AS price_raw,
           price_krw,
           CASE WHEN sold_out THEN '{fv.SOLD_OUT}' ELSE '{fv.PER_NIGHT}' END AS price_basis,
           available
    FROM joined"""
)
def rooms_explode(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as listings, their lines as rooms: one row per room, a default room if none."""
    status = F.col("o_orderstatus")
    listings = table(spark, folder, "orders").select(
        "o_orderkey",
        F.array(F.floor("o_totalprice").cast("string")).alias("prices"),
        F.array(
            F.when(status == "P", "오늘 매진").when(status == "F", "판매가 10%").otherwise("예약 가능")
        ).alias("status_texts"),
    )
    price = F.when(
        F.col("l_linenumber") % 3 != 0, F.format_number(F.floor("l_extendedprice"), 0)
    ).otherwise("문의")
    rooms = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_linenumber").alias("room_no"),
        F.concat(F.col("l_quantity").cast("int"), F.lit("인 객실")).alias("description"),
        F.array(price).alias("prices"),
    )
    return attach_rooms(listings, rooms, "o_orderkey").select(
        "o_orderkey", "room_no", "room_type", "capacity", "capacity_n", "price_raw", "price_krw",
        "price_basis", "available",
    )


def _platform_parts(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Parts as the listings of three platforms with different columns."""
    parts = table(spark, folder, "part")
    name, kind = F.col("p_name").alias("name"), F.col("p_type").alias("lodging_type")
    place, key = F.col("p_brand").alias("location"), F.col("p_partkey")
    price = F.floor("p_retailprice").cast("string")
    rating = F.when(key % 4 != 0, F.col("p_size").cast("string")).alias("rating_raw")
    link = F.when(key % 6 != 2, F.concat(F.lit("/p/"), key)).alias("link")
    missing = F.when(key % 5 == 0, F.lit(None))
    cards = parts.filter(key % 3 == 0).select(
        key,
        F.lit(fv.TRIVAGO).alias("source"),
        name,
        missing.otherwise(kind).alias("lodging_type"),
        place,
        rating,
        missing.otherwise(price).alias("price_raw"),
    )
    rooms = parts.filter(key % 3 == 1).select(
        key,
        F.lit(fv.YANOLJA).alias("source"),
        missing.otherwise(name).alias("name"),
        kind,
        place,
        rating,
        missing.otherwise(price).alias("price_raw"),
        F.lit(fv.PER_NIGHT).alias("price_basis"),
        link,
    )
    lists = parts.filter(key % 3 == 2).select(
        key, F.lit(fv.YEOGI).alias("source"), name, kind, place, rating, price.alias("price_raw"),
        link,
    )
    return [cards, rooms, lists]


_LISTINGS_SQL = f"""
    WITH listings AS (
        SELECT p_partkey,
               CASE p_partkey % 3 WHEN 0 THEN '{fv.TRIVAGO}' WHEN 1 THEN '{fv.YANOLJA}'
                                  ELSE '{fv.YEOGI}' END AS source,
               CASE WHEN p_partkey % 3 = 1 AND p_partkey % 5 = 0 THEN NULL ELSE p_name END AS name,
               CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 = 0 THEN NULL ELSE p_type END
                   AS lodging_type,
               p_brand AS location,
               CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS VARCHAR) END AS rating_raw,
               CASE WHEN p_partkey % 3 < 2 AND p_partkey % 5 = 0 THEN NULL
                    ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) END AS price_raw,
               CASE WHEN p_partkey % 3 = 1 THEN '{fv.PER_NIGHT}' END AS price_basis,
               CASE WHEN p_partkey % 3 > 0 AND p_partkey % 6 <> 2 THEN '/p/' || p_partkey END
                   AS link
        FROM part)"""


@query(_LISTINGS_SQL + "SELECT * FROM listings")
def listings_union(spark: SparkSession, folder: str) -> DataFrame:
    """Listings of three platforms in one table, NULL where a platform lacks the column."""
    return union_listings(*_platform_parts(spark, folder))


def _default_sql(field: str) -> str:
    cases = " ".join(
        f"WHEN source = '{source}' THEN '{texts[field]}'"
        for source, texts in fv.SENTINELS.items()
        if field in texts
    )
    value = f"coalesce({field}, CASE {cases} END)" if cases else field
    return f'{value} AS "{fv.LISTING_HEADERS[field]}"'


@query(f"{_LISTINGS_SQL} SELECT {', '.join(map(_default_sql, fv.LISTING_HEADERS))} FROM listings")
def listings_compat(spark: SparkSession, folder: str) -> DataFrame:
    """The same listings as the platforms' files hold them."""
    return compat_view(union_listings(*_platform_parts(spark, folder)))


@query("SELECT count(*) AS n FROM lineitem")
def counts_total(spark: SparkSession, folder: str) -> DataFrame:
    """Rows collected in all."""
    return counts_by(table(spark, folder, "lineitem"), [])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rooms per listing."""
    return counts_by(table(spark, folder, "lineitem"), ["l_orderkey"])
