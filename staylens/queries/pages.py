"""Queries on captured pages: rankings, cards, lists, links, page ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.functions.addresses import absolute_url, request_from_url, url_parameter
from staylens.functions.markup import Field, Group
from staylens.operators.extract import (
    card_pages,
    extract_aligned,
    extract_cards,
    extract_keywords,
    page_errors as find_page_errors,
    page_prefix as cut_pages,
)
from staylens.operators.ranking import (
    counts_by,
    distinct_first,
    order_key,
    rank_by_order,
    source_report as report_sources,
)
from staylens.operators.rooms import explode_rooms
from staylens.queries import query, table
from staylens.sources import durable
from staylens.specs import CardSpec, KeywordSpec, ListSpec

NAV_TEXT = '<li><a href="[^"]*">([^<]*)</a></li>'
NAV_HREF = '<li><a href="([^"]*)">'
NAV_KEYWORDS = KeywordSpec("pages", pattern=NAV_TEXT)
DEDUPED = "example.com"
RAW = ("example.net", "example.org")
DOMAINS = (DEDUPED, *RAW)
WITHOUT_PAGES = "example.edu"

_SPACES = fv.WHITESPACE.replace("'", "''")
_DOMAIN_SQL = "regexp_extract(url, '^[a-z]+://(?:[^/?#]*[.])?([^./?#]+[.][^./?#]+)', 1)"
# Keywords of all pages in page order, as the nav links have no entities in them.
_KEYWORDS_SQL = f"""
    WITH lists AS (
        SELECT page_id, {_DOMAIN_SQL} AS source,
               regexp_extract_all(html, '{NAV_TEXT}', 1) AS texts
        FROM pages),
    items AS (
        SELECT page_id, source, unnest(texts) AS raw, generate_subscripts(texts, 1) AS pos
        FROM lists),
    keywords AS (
        SELECT page_id, source, trim(raw, '{_SPACES}') AS region, pos
        FROM items WHERE trim(raw, '{_SPACES}') <> '')"""
_DEDUP_SQL = """
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY page_id, pos) AS rank, region
    FROM (SELECT * FROM keywords
          QUALIFY row_number() OVER (PARTITION BY source, region ORDER BY page_id, pos) = 1)"""
_UNION_SQL = f"""{_KEYWORDS_SQL},
    deduped AS ({_DEDUP_SQL}),
    ranked AS (
        SELECT source, rank, region FROM deduped WHERE source = '{DEDUPED}'
        UNION ALL
        SELECT source, row_number() OVER (PARTITION BY source ORDER BY page_id, pos), region
        FROM keywords WHERE source <> '{DEDUPED}')"""


def decoded_sql(text: str) -> str:
    """SQL that replaces the only entities the test pages have."""
    for entity, character in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        text = f"replace({text}, '{entity}', '{character}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def domain(url: Column | str = "url") -> Column:
    """Registrable domain of an address: the stand-in for a platform."""
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
    return F.regexp_extract(host, r"([^.]+[.][^.]+)$", 1)


def keywords(spark: SparkSession, folder: str) -> DataFrame:
    captures = table(spark, folder, "pages").withColumn("source", domain())
    return extract_keywords(captures, NAV_KEYWORDS, ["source", "page_id"])


def placed_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return keywords(spark, folder).select(
        "source", "region", order_key("page_id", "pos").alias("place")
    )


def _ranked(frame: DataFrame, order: str) -> DataFrame:
    return rank_by_order(frame, ["source"], [F.col(order)]).select("source", "rank", "region")


@query(_KEYWORDS_SQL + _DEDUP_SQL)
def rank_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking of the keywords of each domain, its pages taken as one, first occurrences only."""
    first = distinct_first(placed_keywords(spark, folder), ["source", "region"], "place")
    return _ranked(first, "first_pos")


@query(
    _KEYWORDS_SQL
    + """
    SELECT source, page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank, region
    FROM keywords"""
)
def rank_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking of the keywords of each page, repeats included."""
    return keywords(spark, folder).select(
        "source", "page_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "region"
    )


@query(
    _KEYWORDS_SQL
    + """,
    firsts AS (SELECT page_id, region, min(pos) AS pos FROM keywords GROUP BY ALL)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank,
           region
    FROM firsts"""
)
def rank_selector(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking of each page's distinct keywords, found by selector."""
    spec = KeywordSpec("pages", "nav li > a", distinct=True)
    found = extract_keywords(table(spark, folder, "pages"), spec, ["page_id"])
    return found.select("page_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "region")


def _union(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords of every source: of the deduplicated one the first of each, of others all."""
    place = F.when(F.col("source") == DEDUPED, None).otherwise(F.col("place"))
    kept = placed_keywords(spark, folder).withColumn("_each", place)
    return distinct_first(kept, ["source", "region", "_each"], "place", first="place").drop("_each")


@query(_UNION_SQL + "SELECT source, rank, region FROM ranked")
def rank_union(spark: SparkSession, folder: str) -> DataFrame:
    """One ranking table of all sources, of which one is deduplicated."""
    return _ranked(_union(spark, folder), "place")


@query(
    _UNION_SQL
    + f"""
    SELECT s.source, count(r.rank) AS n,
           CASE WHEN count(r.rank) > 0 THEN 'ok' ELSE '{fv.NO_DATA}' END AS status
    FROM (SELECT source FROM keywords UNION SELECT unnest({[*DOMAINS, WITHOUT_PAGES]})) s
    LEFT JOIN ranked r ON r.source = s.source
    GROUP BY s.source"""
)
def source_report(spark: SparkSession, folder: str) -> DataFrame:
    """Items per source, a source without any included."""
    return report_sources(_union(spark, folder), [*DOMAINS, WITHOUT_PAGES])


# One card per page: the body, which holds the heading, the notice and the nav links. Every page
# has all of them, so some are taken away.
PAGE_CARD = CardSpec(
    source="pages",
    card="body",
    fields={
        "name": Field("article h1"),
        "note": Field("div.ad"),
        "first_link": Field("nav a", attr="href"),
    },
    required=("name",),
)
_CARDS_SQL = f"""
    WITH cut AS (
        SELECT page_id,
               CASE WHEN page_id % 7 <> 0 THEN regexp_extract(html, '<h1>([^<]*)</h1>', 1) END
                   AS name,
               CASE WHEN page_id % 5 <> 0
                    THEN regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) END AS note,
               nullif(regexp_extract(html, '{NAV_HREF}', 1), '') AS first_link
        FROM pages),
    cards AS (
        SELECT page_id, 0 AS item_pos, trim({decoded_sql("name")}, '{_SPACES}') AS name,
               coalesce(trim({decoded_sql("note")}, '{_SPACES}'),
                        '{fv.SENTINELS[fv.TRIVAGO]["lodging_type"]}') AS note,
               first_link
        FROM cut)"""


def _cards(spark: SparkSession, folder: str, required: tuple[str, ...]) -> DataFrame:
    html = F.when(
        F.col("page_id") % 7 == 0, F.regexp_replace("html", "<h1>[^<]*</h1>", "")
    ).otherwise(F.col("html"))
    html = F.when(
        F.col("page_id") % 5 == 0, F.regexp_replace(html, '<div class="ad">[^<]*</div>', "")
    ).otherwise(html)
    captures = table(spark, folder, "pages").select("page_id", html.alias("html"))
    default = fv.SENTINELS[fv.TRIVAGO]["lodging_type"]
    return extract_cards(captures, PAGE_CARD, ["page_id"], required).withColumn(
        "note", F.coalesce("note", F.lit(default))
    )


@query(_CARDS_SQL + "SELECT * FROM cards WHERE name IS NOT NULL")
def cards_required(spark: SparkSession, folder: str) -> DataFrame:
    """Cards with a name; a missing notice gets its default."""
    return _cards(spark, folder, ("name",))


@query(
    _CARDS_SQL
    + f"""SELECT page_id, item_pos, coalesce(name, '{fv.SENTINELS[fv.YANOLJA]["name"]}') AS name,
                 note, first_link FROM cards"""
)
def cards_optional(spark: SparkSession, folder: str) -> DataFrame:
    """All cards; every missing field gets its default."""
    default = fv.SENTINELS[fv.YANOLJA]["name"]
    return _cards(spark, folder, ()).withColumn("name", F.coalesce("name", F.lit(default)))


@query(
    f"""
    WITH lists AS (
        SELECT page_id, regexp_extract_all(html, '{NAV_HREF}', 1) AS links,
               regexp_extract_all(html, '{NAV_TEXT}', 1) AS names,
               regexp_extract_all(html, '<p>([^<]*)', 1) AS texts
        FROM pages),
    sized AS (
        SELECT *, least(len(links), len(names), len(texts)) AS n,
               greatest(len(links), len(names), len(texts)) AS longest FROM lists),
    items AS (SELECT *, unnest(range(n)) AS item_pos FROM sized)
    SELECT page_id, CAST(item_pos AS INTEGER) AS item_pos, links[item_pos + 1] AS link,
           names[item_pos + 1] AS name, {decoded_sql("texts[item_pos + 1]")} AS text,
           n <> longest AS misaligned
    FROM items"""
)
def aligned_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Links, link texts and paragraphs of a page matched by position, up to the shortest list."""
    spec = ListSpec(
        "pages",
        {
            "link": Field("nav a", attr="href", many=True),
            "name": Field("nav a", many=True),
            "text": Field("p", text="own", many=True),
        },
    )
    return extract_aligned(table(spark, folder, "pages"), spec, ["page_id"])


@query(
    f"""
    WITH lists AS (
        SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS base,
               regexp_extract_all(html, '{NAV_HREF}', 1) AS links
        FROM pages),
    items AS (
        SELECT page_id, base, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS pos
        FROM lists)
    SELECT page_id, CAST(pos AS INTEGER) AS pos,
           CASE (page_id + pos) % 5 WHEN 0 THEN '{fv.SENTINELS[fv.YEOGI]["link"]}'
                WHEN 1 THEN 'https://host.example' || link ELSE base || link END AS link
    FROM items"""
)
def links_absolute(spark: SparkSession, folder: str) -> DataFrame:
    """Link addresses of a page with its own host; absolute ones as they are, empty ones marked."""
    links = F.regexp_extract_all("html", F.lit(NAV_HREF), F.lit(1))
    found = table(spark, folder, "pages").select(
        "page_id",
        F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0).alias("base"),
        F.posexplode(links).alias("pos", "href"),
    )
    kind = (F.col("page_id") + F.col("pos")) % 5
    href = F.when(kind == 0, "").when(
        kind == 1, F.concat(F.lit("https://host.example"), "href")
    ).otherwise(F.col("href"))
    link = F.coalesce(absolute_url(F.col("base"), href), F.lit(fv.SENTINELS[fv.YEOGI]["link"]))
    return found.select("page_id", "pos", link.alias("link"))


@query(
    """
    SELECT page_id, try_cast(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS INTEGER)
               AS page_no,
           nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref,
           nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source
    FROM pages"""
)
def url_params(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters of the address a page was captured from."""
    return table(spark, folder, "pages").select(
        "page_id",
        request_from_url("url")["page_no"].alias("page_no"),
        url_parameter("url", "ref").alias("ref"),
        url_parameter("url", "utm_source").alias("utm_source"),
    )


@query(
    """
    WITH days AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type FROM events),
    span AS (SELECT min(day) AS first_day, max(day) AS last_day FROM days),
    grid AS (
        SELECT user_id, CAST(unnest(range(0, 1 + date_diff('day', first_day, last_day)))
                             AS INTEGER) + 1 AS page_no, first_day
        FROM (SELECT DISTINCT user_id FROM days), span),
    pages_of AS (
        SELECT g.user_id, g.page_no, count(d.user_id) AS n_items
        FROM grid g LEFT JOIN days d ON d.user_id = g.user_id AND d.event_type = 'view'
             AND date_diff('day', g.first_day, d.day) + 1 = g.page_no
        GROUP BY ALL),
    stops AS (SELECT user_id, min(page_no) AS stop FROM pages_of WHERE n_items = 0 GROUP BY ALL)
    SELECT p.user_id, p.page_no, p.n_items
    FROM pages_of p LEFT JOIN stops s ON s.user_id = p.user_id
    WHERE s.stop IS NULL OR p.page_no < s.stop"""
)
def page_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a request before its first empty one: days of a user, views as items."""
    events = table(spark, folder, "events").select(
        "user_id", F.to_date("ts").alias("day"), "event_type"
    )
    first = events.select(F.min("day")).scalar()
    per_day = (
        events.filter(F.col("event_type") == "view")
        .groupBy("user_id", "day")
        .agg(F.count("*").alias("n_items"))
        .select("user_id", (F.datediff("day", first) + 1).alias("page_no"), "n_items")
    )
    # Of the days without views only those that end a run of days with views are pages, and the
    # first day: one row for each gap, however long it is.
    days = W.partitionBy("user_id").orderBy("page_no")
    before, after = F.lag("page_no").over(days), F.lead("page_no").over(days)
    empty = F.lit(0).cast("bigint").alias("n_items")
    own = F.array(F.struct("page_no", "n_items"))
    start = F.when(
        F.col("before").isNull() & (F.col("page_no") > 1),
        F.array(F.struct(F.lit(1).alias("page_no"), empty)),
    ).otherwise(F.array())
    end = F.when(
        F.coalesce(F.col("after") > F.col("page_no") + 1, F.lit(True)),
        F.array(F.struct((F.col("page_no") + 1).alias("page_no"), empty)),
    ).otherwise(F.array())
    captured = durable(
        per_day.select("*", before.alias("before"), after.alias("after"))
        .select("user_id", F.inline(F.concat(own, start, end)))
    )
    return cut_pages(captured, "user_id")


# The notice stands in for the next-page button; on some pages its class says it is disabled.
_PAGED_CARD = CardSpec(
    source="pages", card="article", fields={"name": Field("h1")}, next_page="div.ad"
)


@query(
    f"""
    WITH numbered AS (
        SELECT {_DOMAIN_SQL} AS source, page_id, html, page_id % 50 = 37 AS is_last FROM pages),
    stops AS (SELECT source, min(page_id) AS stop FROM numbered WHERE is_last GROUP BY source)
    SELECT n.source, n.page_id, trim({decoded_sql("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")},
                                     '{_SPACES}') AS name, is_last
    FROM numbered n LEFT JOIN stops s ON s.source = n.source
    WHERE s.stop IS NULL OR n.page_id <= s.stop"""
)
def last_page(spark: SparkSession, folder: str) -> DataFrame:
    """Cards of a request up to the page whose next-page button is disabled."""
    disabled = F.replace("html", F.lit('<div class="ad">'), F.lit('<div class="ad disabled">'))
    html = F.when(F.col("page_id") % 50 == 37, disabled).otherwise(F.col("html"))
    captures = table(spark, folder, "pages").select(
        domain().alias("source"), "page_id", html.alias("html")
    )
    pages = durable(card_pages(captures, _PAGED_CARD, ["source", "page_id"]))
    kept = cut_pages(pages, "source", "page_id", is_last="is_last")
    return kept.select("source", "page_id", F.explode("items").alias("card"), "is_last").select(
        "source", "page_id", "card.name", "is_last"
    )


# Paragraphs as rooms: a page whose paragraphs are turned into divisions is a listing without.
_ROOM_CARD = CardSpec(
    source="pages",
    card="article",
    fields={
        "rooms": Group(
            "p", {"description": Field("", text="own"), "prices": Field("i", many=True)}
        ),
        "status_texts": Field("h1", many=True),
    },
)


@query(
    f"""
    WITH lists AS (
        SELECT page_id, regexp_extract(url, '[0-9]+') AS price,
               CASE WHEN page_id % 7 = 0 THEN []
                    ELSE regexp_extract_all(html, '<p>([^<]*)', 1) END AS texts
        FROM pages),
    rooms AS (
        SELECT page_id, price, unnest(texts) AS text, generate_subscripts(texts, 1) - 1 AS pos
        FROM lists
        UNION ALL SELECT page_id, price, NULL, 0 FROM lists WHERE len(texts) = 0)
    SELECT page_id, CAST(pos AS INTEGER) AS room_pos,
           coalesce(nullif(substring({decoded_sql("text")}, 1, {fv.ROOM_TYPE_LENGTH}), ''),
                    '{fv.DEFAULT_ROOM}') AS room_type,
           '{fv.DEFAULT_CAPACITY}' AS capacity, price AS price_raw,
           CAST(price AS BIGINT) AS price_krw, '{fv.PER_NIGHT}' AS price_basis, true AS available
    FROM rooms"""
)
def rooms_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Rooms read from within a listing, one row each; a default room where there are none."""
    html = F.when(
        F.col("page_id") % 7 == 0, F.replace("html", F.lit("<p>"), F.lit("<div>"))
    ).otherwise(F.col("html"))
    captures = table(spark, folder, "pages").select("page_id", "url", html.alias("html"))
    found = extract_cards(captures, _ROOM_CARD, ["page_id", "url"])
    price = F.array(F.regexp_extract("url", "[0-9]+", 0)).alias("prices")
    listings = found.select("page_id", price, "rooms", "status_texts")
    return explode_rooms(listings).select(
        "page_id", "room_pos", "room_type", "capacity", "price_raw", "price_krw", "price_basis",
        "available",
    )


@query(f"SELECT {_DOMAIN_SQL} AS source, page_id FROM pages WHERE page_id % 9 = 4")
def page_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that cannot be read: some are given a section that is not HTML."""
    html = F.when(F.col("page_id") % 9 == 4, F.concat("html", F.lit("<![broken["))).otherwise(
        F.col("html")
    )
    captures = table(spark, folder, "pages").select(
        domain().alias("source"), "page_id", html.alias("html")
    )
    return find_page_errors(captures, ["source", "page_id"]).select("source", "page_id")


@query(_KEYWORDS_SQL + "SELECT source, page_id, count(*) AS n FROM keywords GROUP BY ALL")
def counts_per_page(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords per page."""
    return counts_by(keywords(spark, folder), ["source", "page_id"])
