"""Rows from captured pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from staylens.functions.markup import Field, Group, read_markup
from staylens.functions.text import as_column, strip
from staylens.schemas import CAPTURE_KEYS
from staylens.specs import CardSpec, KeywordSpec, ListSpec


def card_pages(
    captures: DataFrame, spec: CardSpec, keys: Sequence[str] = CAPTURE_KEYS
) -> DataFrame:
    """One row per page: its cards as an array, how many there are, and whether it is the last.

    A page is the last if its next-page button is missing or disabled. ``n_items`` is counted
    before cards that lack a required field are left out; it is NULL for a page without HTML or
    one that could not be read, which therefore does not end a request.
    """
    shape: dict[str, Field | Group] = {"cards": Group(spec.card, spec.fields)}
    if spec.next_page:
        shape["next_class"] = Field(spec.next_page, attr="class")
        shape["next_disabled"] = Field(f"{spec.next_page}[disabled]", attr="disabled")
    pages = captures.select(*keys, read_markup("html", shape).alias("page"))
    if spec.next_page:
        button = F.col("page.next_class")
        last = button.isNull() | button.contains("disabled") | F.col("page.next_disabled").isNotNull()
    else:
        last = F.lit(False)
    return pages.select(
        *keys,
        F.filter("page.cards", lambda card: _complete(card, spec.required)).alias("items"),
        F.array_size("page.cards").alias("n_items"),
        (last & F.col("page.cards").isNotNull()).alias("is_last"),
        F.col("page.error").alias("error"),
    )


def _complete(card: Column, required: Sequence[str]) -> Column:
    found = F.lit(True)
    for name in required:
        found = found & card[name].isNotNull()
    return found


def _read_pages(
    captures: DataFrame,
    shape: dict[str, Field | Group],
    keys: Sequence[str],
    observation: Observation | None,
) -> DataFrame:
    """Pages with ``page``, what the reader found; ``observation`` gets ``pages`` and ``unread`` of the same pass."""
    pages = captures.select(*keys, read_markup("html", shape).alias("page"))
    if observation is None:
        return pages
    unread = F.count_if(F.col("page.error").isNotNull()).alias("unread")
    return pages.observe(observation, F.count("*").alias("pages"), unread)


def extract_cards(
    captures: DataFrame,
    spec: CardSpec,
    keys: Sequence[str] = CAPTURE_KEYS,
    required: Sequence[str] | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """One row per card that has every required field.

    ``required`` replaces the fields the specification asks for; ``()`` keeps every card. After a run
    ``observation`` holds the numbers of ``pages`` and of those ``unread``, without a second reading. What
    makes Spark go over the rows twice, as the sample of a global sort does, counts them twice.
    """
    required = spec.required if required is None else required
    shape: dict[str, Field | Group] = {"cards": Group(spec.card, spec.fields)}
    if observation is None:
        cards = read_markup("html", shape)["cards"]
        numbered = captures.select(*keys, F.posexplode(cards).alias("item_pos", "card"))
    else:
        pages = _read_pages(captures, shape, keys, observation)
        numbered = pages.select(*keys, F.posexplode("page.cards").alias("item_pos", "card"))
    return numbered.filter(_complete(F.col("card"), required)).select(*keys, "item_pos", "card.*")


def stored_errors(pages: DataFrame, keys: Sequence[str] = CAPTURE_KEYS) -> DataFrame:
    """The same as :func:`page_errors` for pages that :func:`card_pages` or :func:`list_pages` has read."""
    return pages.where(F.col("error").isNotNull()).select(*keys, "error")


def page_errors(captures: DataFrame, keys: Sequence[str] = CAPTURE_KEYS) -> DataFrame:
    """One row per page that the reader could not read, with what it said: pages other rows lack.

    It reads the pages for that alone. :func:`extract_cards` and :func:`extract_aligned` count unread
    pages in their own pass, and stored pages name them (:func:`stored_errors`).
    """
    error = read_markup("html", {})["error"]
    # Exploded where it is made, so the page is read once.
    said = F.filter(F.array(error), lambda text: text.isNotNull())
    return captures.select(*keys, F.explode(said).alias("error"))


def aligned(lists: dict[str, Column | str]) -> Column:
    """Arrays zipped by position into an array of structs, as long as the shortest of them.

    ``arrays_zip`` alone pads the shorter ones with NULL. If an array is NULL, so is the result.
    """
    columns = {name: as_column(column) for name, column in lists.items()}
    return F.slice(_zipped(columns), F.lit(1), _of_sizes(F.least, columns))


def _of_sizes(function: Callable[..., Column], arrays: dict[str, Column]) -> Column:
    """Least or greatest of the arrays' sizes, of which there may be one."""
    sizes = [F.array_size(array) for array in arrays.values()]
    return function(*sizes) if len(sizes) > 1 else sizes[0]


def _zipped(columns: dict[str, Column]) -> Column:
    return F.arrays_zip(*[column.alias(name) for name, column in columns.items()])


def list_pages(
    captures: DataFrame,
    spec: ListSpec,
    keys: Sequence[str] = CAPTURE_KEYS,
    observation: Observation | None = None,
) -> DataFrame:
    """One row per page: its lists zipped, the size of the shortest, and whether sizes differ.

    The listings of a page are the first ``n_items`` entries of ``zipped``. If the lists differ
    in size, fields of different listings may have come together.
    """
    pages = _read_pages(captures, dict(spec.lists), keys, observation)
    lists = {name: F.col(f"page.{name}") for name in spec.lists}
    shortest, longest = _of_sizes(F.least, lists), _of_sizes(F.greatest, lists)
    return pages.select(
        *keys,
        _zipped(lists).alias("zipped"),
        shortest.alias("n_items"),
        (shortest != longest).alias("misaligned"),
        F.col("page.error").alias("error"),
    )


def explode_lists(pages: DataFrame, keys: Sequence[str] = CAPTURE_KEYS) -> DataFrame:
    """One row per position of the pages' lists, up to the shortest."""
    items = F.slice("zipped", F.lit(1), F.col("n_items"))
    return pages.select(
        *keys, "misaligned", F.posexplode(items).alias("item_pos", "item")
    ).select(*keys, "item_pos", "item.*", "misaligned")


def extract_aligned(
    captures: DataFrame,
    spec: ListSpec,
    keys: Sequence[str] = CAPTURE_KEYS,
    observation: Observation | None = None,
) -> DataFrame:
    """One row per listing of pages read as parallel lists; ``observation`` as in :func:`extract_cards`."""
    return explode_lists(list_pages(captures, spec, keys, observation), keys)


def keyword_list(spec: KeywordSpec, html: Column | str = "html") -> Column:
    """Keywords of a page in page order, stripped, without blanks, and distinct if asked for.

    The position in the array is the rank within the page, so ranking a page needs no shuffle.
    """
    if spec.pattern is not None:
        raw = F.regexp_extract_all(as_column(html), F.lit(spec.pattern), F.lit(1))
    else:
        field = Field(spec.selector, text=spec.text, many=True)
        if spec.section is None:
            raw = read_markup(html, {"keywords": field})["keywords"]
        else:
            sections = {"sections": Group(spec.section, {"keywords": field})}
            raw = F.get(read_markup(html, sections)["sections"], F.lit(0))["keywords"]
    kept = F.filter(F.transform(raw, strip), lambda keyword: keyword != "")
    return F.array_distinct(kept) if spec.distinct else kept


def extract_keywords(
    captures: DataFrame, spec: KeywordSpec, keys: Sequence[str] = CAPTURE_KEYS
) -> DataFrame:
    """One row per keyword, with its position on the page (from 0)."""
    return captures.select(*keys, F.posexplode(keyword_list(spec)).alias("pos", "region"))


def page_prefix(
    pages: DataFrame,
    request: str | Sequence[str] = "request_id",
    page: str = "page_no",
    n: str = "n_items",
    is_last: str | None = None,
) -> DataFrame:
    """Pages of each request up to the first one without items, or up to the last-page flag.

    The first page without items is left out, a flagged page is kept. A page that was never
    captured does not end a request. Each request is reduced to its two page numbers before the
    join, and the join has one row per request on one side, so a hot request can be split.
    """
    keys = [request] if isinstance(request, str) else list(request)
    empty = F.min(F.when(F.col(n) == 0, F.col(page))).alias("_empty")
    flagged = F.min(F.when(F.col(is_last), F.col(page))).alias("_last") if is_last else None
    ends = F.col(n) == 0 if flagged is None else (F.col(n) == 0) | F.col(is_last)
    stops = pages.filter(ends).groupBy(*keys).agg(*[c for c in (empty, flagged) if c is not None])
    within = F.coalesce(F.col(page) < F.col("_empty"), F.lit(True))
    if flagged is not None:
        within = within & F.coalesce(F.col(page) <= F.col("_last"), F.lit(True))
    return pages.join(stops, keys, "left").filter(within).select(*pages.columns)
