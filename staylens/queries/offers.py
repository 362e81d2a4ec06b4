"""Queries on priced offers: comparison, value order, restaurants, posts.

Order lines stand in for offers: the part is the lodging, the supplier's nation the region, the
supplier's number the platform. Every platform writes the name of a lodging in its own way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.functions import rating10
from staylens.operators import compare, nearby
from staylens.queries import query, table

PLATFORMS = (fv.TRIVAGO, fv.YANOLJA, fv.YEOGI)

_OFFERS_SQL = f"""
    WITH offers AS (
        SELECT CASE l_suppkey % 3 WHEN 0 THEN '{fv.TRIVAGO}' WHEN 1 THEN '{fv.YANOLJA}'
                                  ELSE '{fv.YEOGI}' END AS source,
               CASE l_suppkey % 3 WHEN 0 THEN upper(p_name) || ' #' || p_partkey
                    WHEN 1 THEN replace(p_name, ' ', '-') || '-' || p_partkey
                    ELSE p_name || ' (' || p_partkey || ')' END AS name,
               replace(p_name, ' ', '') || p_partkey AS match_key,
               n_name AS location,
               CASE WHEN l_suppkey % 3 = 1 THEN CAST(2 * p_size AS DOUBLE) / 10
                    ELSE CAST(p_size AS DOUBLE) / 10 END AS rating10,
               CAST(CASE WHEN l_suppkey % 3 = 1 THEN 2 * p_size ELSE p_size END AS BIGINT)
                   AS rating_tenths,
               CAST(floor(l_extendedprice) AS BIGINT) AS price_krw,
               CASE WHEN l_linestatus = 'F' THEN '{fv.PER_NIGHT}' ELSE '' END AS basis,
               l_returnflag <> 'R' AS available
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
             JOIN nation ON n_nationkey = s_nationkey),
    scored AS (
        SELECT *, CASE WHEN price_krw > 0
                       THEN rating10 / (CAST(price_krw AS DOUBLE) / 10000.0) END AS value_score
        FROM offers),
    lodgings AS (
        SELECT match_key, location, source, min(price_krw) AS price_krw, min(basis) AS low,
               max(basis) AS high
        FROM offers WHERE available GROUP BY ALL)"""
_VALUE_ORDER_SQL = "value_score DESC NULLS LAST, price_krw, rating10 DESC NULLS LAST, name, source"
_VALUE_COLUMNS = ("location", "source", "name", "rating10", "price_krw", "value_score")


def offers(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as typed listings. The small tables are left to the size-checked broadcast."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"),
        F.col("l_suppkey").alias("s_suppkey"),
        F.floor("l_extendedprice").alias("price_krw"),
        F.when(F.col("l_linestatus") == "F", fv.PER_NIGHT).alias("price_basis"),
        (F.col("l_returnflag") != "R").alias("available"),
    )
    # What depends on the part alone is computed before the join, once per part.
    key = F.col("p_partkey").cast("string")
    rating = F.concat(F.floor(F.col("p_size") / 10), F.lit("."), F.col("p_size") % 10)
    parts = table(spark, folder, "part").select(
        "p_partkey",
        F.concat(F.upper("p_name"), F.lit(" #"), key).alias("name0"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), key).alias("name1"),
        F.concat("p_name", F.lit(" ("), key, F.lit(")")).alias("name2"),
        *[
            rating10(rating, F.lit(source)).alias(f"rating{platform}")
            for platform, source in enumerate(PLATFORMS)
        ],
    )
    regions = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("location"))
    )
    platform = (F.col("s_suppkey") % 3).cast("int")

    def of_platform(*choices: Column) -> Column:
        return F.when(platform == 0, choices[0]).when(platform == 1, choices[1]).otherwise(choices[2])

    return (
        lines.join(regions, "s_suppkey")
        .join(parts, "p_partkey")
        .select(
            of_platform(*map(F.lit, PLATFORMS)).alias("source"),
            of_platform(*[F.col(f"name{i}") for i in range(3)]).alias("name"),
            "location",
            of_platform(*[F.col(f"rating{i}") for i in range(3)]).alias("rating10"),
            "price_krw",
            "price_basis",
            "available",
        )
    )


@query(
    _OFFERS_SQL
    + """
    SELECT location, source, count(*) AS n, min(price_krw) AS min_price,
           CAST(sum(price_krw) AS DOUBLE) / count(*) AS avg_price,
           median(price_krw) AS median_price,
           CAST(sum(rating_tenths) AS DOUBLE) / 10 / count(*) AS avg_rating,
           min(basis) <> max(basis) AS mixed_basis
    FROM offers WHERE available GROUP BY location, source"""
)
def platform_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Count, lowest, mean and median price and mean rating per region and platform."""
    return compare.compare_platforms(offers(spark, folder))


@query(
    _OFFERS_SQL
    + f"""
    SELECT match_key, location,
           {", ".join(f"min(price_krw) FILTER (source = '{p}') AS {p}" for p in PLATFORMS)},
           min(low) <> max(high) AS mixed_basis
    FROM lodgings GROUP BY match_key, location"""
)
def platform_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """One row per lodging, one price column per platform."""
    return compare.pivot_prices(offers(spark, folder), PLATFORMS)


@query(
    _OFFERS_SQL
    + """
    SELECT match_key, location, source, price_krw,
           first_value(source) OVER lodging AS cheapest_source,
           price_krw - first_value(price_krw) OVER lodging AS gap,
           count(*) OVER (PARTITION BY match_key, location) AS n_platforms,
           min(low) OVER (PARTITION BY match_key, location)
               <> max(high) OVER (PARTITION BY match_key, location) AS mixed_basis
    FROM lodgings
    WINDOW lodging AS (PARTITION BY match_key, location ORDER BY price_krw, source)"""
)
def platform_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Lowest price per lodging and platform, with the cheapest platform and the gap to it."""
    return compare.price_gap(offers(spark, folder))


# A part's first word and its supplier's region stand in for the lodging, an order for the request.
_STAYS_SQL = f"""
    WITH offers AS (
        SELECT CASE l_suppkey % 3 WHEN 0 THEN '{fv.TRIVAGO}' WHEN 1 THEN '{fv.YANOLJA}'
                                  ELSE '{fv.YEOGI}' END AS source,
               split_part(p_name, ' ', 1) AS match_key, r_name AS location,
               CAST(date_trunc('month', o_orderdate) AS DATE) AS check_in,
               CAST(o_orderkey % 4 AS INTEGER) AS nights,
               CAST(floor(l_extendedprice) AS BIGINT) AS price_krw,
               l_linestatus = 'F' AS one_night
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
             JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
             JOIN region ON r_regionkey = n_regionkey
        WHERE l_returnflag <> 'R'),
    lodgings AS (
        SELECT match_key, check_in, nights, location, source,
               min(CASE WHEN one_night THEN CAST(price_krw AS DOUBLE)
                        ELSE CAST(price_krw AS DOUBLE) / nights END) AS per_night,
               min(one_night) AS low, max(one_night) AS high
        FROM offers WHERE nights > 0 GROUP BY ALL)"""


def stay_offers(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as listings that answer an order, the request."""
    regions = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("location"))
    )
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")
    )
    lines = table(spark, folder, "lineitem").join(regions, "l_suppkey").join(parts, "l_partkey")
    platform = (F.col("l_suppkey") % 3 + 1).cast("int")
    return lines.select(
        F.col("l_orderkey").alias("request_id"),
        F.element_at(F.array(*map(F.lit, PLATFORMS)), platform).alias("source"),
        "name",
        "location",
        F.floor("l_extendedprice").alias("price_krw"),
        F.when(F.col("l_linestatus") == "F", fv.PER_NIGHT).alias("price_basis"),
        (F.col("l_returnflag") != "R").alias("available"),
    )


def stay_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as requests to every platform; some are for no night at all."""
    check_in = F.trunc("o_orderdate", "month")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.explode(F.array(*map(F.lit, PLATFORMS))).alias("source"),
        check_in.alias("check_in"),
        F.date_add(check_in, (F.col("o_orderkey") % 4).cast("int")).alias("check_out"),
    )


@query(
    _STAYS_SQL
    + """
    SELECT match_key, location, source, CAST(check_in AS VARCHAR) AS check_in, nights, per_night,
           first_value(source) OVER lodging AS cheapest_source,
           per_night - first_value(per_night) OVER lodging AS gap,
           count(*) OVER same_stay AS n_platforms,
           min(low) OVER same_stay <> max(high) OVER same_stay AS mixed_basis
    FROM lodgings
    WINDOW lodging AS (PARTITION BY match_key, location, check_in, nights ORDER BY per_night, source),
           same_stay AS (PARTITION BY match_key, location, check_in, nights)"""
)
def stay_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Lowest price per night and platform for equal stays, with the gap to the cheapest platform."""
    found = compare.per_night_gap(stay_offers(spark, folder), stay_requests(spark, folder))
    return found.drop("check_out").withColumn("check_in", F.col("check_in").cast("string"))


def _value_columns(frame: DataFrame) -> DataFrame:
    return frame.select(*_VALUE_COLUMNS, "value_rank").withColumn(
        "rating10", F.col("rating10").cast("double")
    )


@query(
    _OFFERS_SQL
    + f"""
    SELECT {", ".join(_VALUE_COLUMNS)},
           row_number() OVER (PARTITION BY location ORDER BY {_VALUE_ORDER_SQL}) AS value_rank
    FROM scored"""
)
def value_rank(spark: SparkSession, folder: str) -> DataFrame:
    """All offers of a region by value for money."""
    return _value_columns(compare.value_rank(offers(spark, folder), per=["location"]))


@query(
    _OFFERS_SQL
    + f"""
    SELECT {", ".join(_VALUE_COLUMNS)},
           row_number() OVER (ORDER BY {_VALUE_ORDER_SQL}, location) AS value_rank
    FROM scored"""
)
def value_rank_overall(spark: SparkSession, folder: str) -> DataFrame:
    """All offers by value for money."""
    return _value_columns(compare.value_rank(offers(spark, folder), ties=["location"]))


@query(
    _OFFERS_SQL
    + f"""
    SELECT {", ".join(_VALUE_COLUMNS)}, value_rank
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY location ORDER BY {_VALUE_ORDER_SQL})
                         AS INTEGER) AS value_rank FROM scored)
    WHERE value_rank <= 5"""
)
def value_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best offers of every region."""
    return _value_columns(compare.top_value(offers(spark, folder), 5))


# Four of the five market segments as cuisines.
_SEGMENTS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_NEAR_SQL = f"""
    WITH lodgings AS (
        SELECT s_suppkey, s_name AS name, n_name AS location
        FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    places AS (
        SELECT c_custkey AS place_id, c_name AS name, n_name AS region,
               CASE c_mktsegment
               {" ".join(f"WHEN '{s}' THEN '{c}'" for s, c in zip(_SEGMENTS, fv.CUISINES))}
               ELSE 'other' END AS cuisine
        FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def _lodgings(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    return table(spark, folder, "supplier").join(
        nation, F.col("n_nationkey") == F.col("s_nationkey")
    ).select("s_suppkey", F.col("s_name").alias("name"), F.col("n_name").alias("location"))


def _places(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    cuisine = F.lit("other")
    for segment, name in zip(_SEGMENTS, fv.CUISINES):
        cuisine = F.when(F.col("c_mktsegment") == segment, name).otherwise(cuisine)
    return table(spark, folder, "customer").join(
        nation, F.col("n_nationkey") == F.col("c_nationkey")
    ).select(
        F.col("c_custkey").alias("place_id"),
        F.col("c_name").alias("name"),
        cuisine.alias("cuisine"),
        F.col("n_name").alias("region"),
    )


@query(
    _NEAR_SQL
    + """
    SELECT place_id, name, cuisine, region, n_lodgings
    FROM places JOIN (SELECT location, count(DISTINCT name) AS n_lodgings FROM lodgings GROUP BY 1)
         ON location = region
    WHERE cuisine <> 'other'"""
)
def near_places(spark: SparkSession, folder: str) -> DataFrame:
    """Restaurants in the regions of the lodgings, each once, with the lodgings it is near to."""
    return nearby.near_restaurants(_lodgings(spark, folder), _places(spark, folder))


@query(
    _NEAR_SQL
    + f"""
    SELECT s_suppkey, l.name, l.location,
           {", ".join(f'''count(*) FILTER (cuisine = '{c}') AS "near_{c}"''' for c in fv.CUISINES)}
    FROM lodgings l LEFT JOIN places p ON p.region = l.location
    GROUP BY s_suppkey, l.name, l.location"""
)
def near_cuisines(spark: SparkSession, folder: str) -> DataFrame:
    """Lodgings with the number of restaurants near them per cuisine."""
    return nearby.near_cuisine_counts(_lodgings(spark, folder), _places(spark, folder))


_POSTS_SQL = """
    WITH posts AS (
        SELECT event_id AS post_id, 'R' || (user_id % 25) AS region, ts AS posted_at,
               strftime(ts, '%Y-%m-%d') AS posted_on
        FROM events WHERE event_type = 'signup' AND year(ts) = 2024)"""


def _posts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("post_id"),
        F.concat(F.lit("R"), F.col("user_id") % 25).alias("region"),
        F.col("ts").alias("posted_at"),
        F.col("event_type").alias("text"),
    )


@query(
    _POSTS_SQL
    + """
    SELECT region, posted_on, count(*) AS n, epoch_us(min(posted_at)) AS first_us,
           epoch_us(max(posted_at)) AS last_us
    FROM posts GROUP BY region, posted_on"""
)
def posts_by_date(spark: SparkSession, folder: str) -> DataFrame:
    """Festival posts per region and day."""
    days = nearby.festival_by_date(_posts(spark, folder), year=2024, word="signup")
    return days.select(
        "region",
        F.col("posted_on").cast("string").alias("posted_on"),
        "n",
        F.unix_micros(F.col("first_at").cast("timestamp")).alias("first_us"),
        F.unix_micros(F.col("last_at").cast("timestamp")).alias("last_us"),
    )


@query(_POSTS_SQL + "SELECT post_id, region, posted_on FROM posts")
def posts_dated(spark: SparkSession, folder: str) -> DataFrame:
    """Festival posts with the day they were posted."""
    posts = nearby.festival_posts(_posts(spark, folder), year=2024, word="signup")
    return posts.select("post_id", "region", F.col("posted_on").cast("string").alias("posted_on"))
