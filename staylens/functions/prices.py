"""Price and availability functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.functions.text import as_column, ascii_digits, contains_any, first_match, join_spans


def price_digits(texts: Column | str) -> Column:
    """Digits of the first candidate text whose first number run has digits, NULL if none has.

    Only the first run of each text is looked at: ``10% 54,000원`` gives ``10``.
    """
    runs = F.transform(
        as_column(texts),
        lambda text: F.replace(F.regexp_extract(text, fv.NUMBER_RUN, 0), F.lit(","), F.lit("")),
    )
    return F.get(F.filter(runs, lambda run: run != ""), F.lit(0))


def price_first(texts: Column | str) -> Column:
    """Numeric price of the first candidate text that has one: typed form of ``price_digits``."""
    prices = F.transform(as_column(texts), price_krw)
    return F.get(F.filter(prices, lambda price: price.isNotNull()), F.lit(0))


def price_won(text: Column | str) -> Column:
    """First number run with its commas, followed by the won sign; NULL without a run."""
    return F.concat(first_match(text, fv.NUMBER_RUN), F.lit(fv.WON))


def price_joined(texts: Column | str) -> Column:
    """Price parts joined by spaces, with no space before the won sign or a slash."""
    joined = join_spans(texts)
    for mark in (fv.WON, "/"):
        joined = F.replace(joined, F.lit(" " + mark), F.lit(mark))
    return joined


def price_krw(text: Column | str) -> Column:
    """Numeric price of any of the text forms: the number before the won sign, else the first."""
    column = as_column(text)
    first = first_match(column, r"(?U)\d[\d,]*")
    # The second pattern is tried only where there is a won sign.
    before_sign = first_match(column, r"(?U)(\d[\d,]*)\s*" + fv.WON, 1)
    number = F.when(column.contains(fv.WON), F.coalesce(before_sign, first)).otherwise(first)
    return digits_krw(F.replace(number, F.lit(","), F.lit("")))


def digits_krw(digits: Column | str) -> Column:
    """Numeric price of a text of digits; NULL if it is none or too long."""
    return ascii_digits(digits).try_cast("bigint")


def no_rooms(rooms: Column | str) -> Column:
    """Whether an array of rooms is NULL or empty."""
    return F.coalesce(F.array_size(as_column(rooms)), F.lit(0)) == 0


def availability(
    rooms: Column | str,
    status_texts: Column | str,
    words: Sequence[str] = fv.SOLD_OUT_WORDS,
) -> Column:
    """Whether a listing can be booked: it has rooms, or no status text says it is sold out."""
    sold_out = F.exists(as_column(status_texts), lambda text: contains_any(text, words))
    return ~(no_rooms(rooms) & F.coalesce(sold_out, F.lit(False)))


def price_basis(available: Column | str, failed: Column | None = None) -> Column:
    """What a price covers: one night, sold out, or not readable."""
    basis = F.when(~as_column(available), fv.SOLD_OUT).otherwise(fv.PER_NIGHT)
    return basis if failed is None else F.when(failed, fv.FAILED).otherwise(basis)
