"""Text functions. All of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens import fixed_values as fv


def as_column(value: Column | str) -> Column:
    """A column, given a column or its name."""
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Text without Unicode white space at either end (SQL ``trim`` removes only U+0020)."""
    return F.btrim(as_column(text), F.lit(fv.WHITESPACE))


def ascii_digits(text: Column | str) -> Column:
    """Full-width digits as ASCII digits, which numeric casts need."""
    return F.translate(as_column(text), "０１２３４５６７８９", "0123456789")


def first_match(text: Column | str, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, NULL if there is none (``regexp_extract`` gives ``''``).

    Casts should get NULL, not ``''``: a failing ``try_cast`` raises and catches an error per row.
    ``nullif`` would evaluate the pattern twice inside a lambda or a condition.
    """
    return F.get(F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(group)), F.lit(0))


def contains_any(text: Column | str, words: Sequence[str]) -> Column:
    """Whether the text holds any of the words."""
    column = as_column(text)
    return reduce(lambda left, right: left | right, [column.contains(word) for word in words])


def join_spans(texts: Column | str) -> Column:
    """Texts of an array, each stripped, joined by one space."""
    return F.array_join(F.transform(as_column(texts), strip), " ")


def room_type(description: Column | str) -> Column:
    """First 30 characters of a room description; a fixed name if it is empty."""
    head = F.substring(as_column(description), 1, fv.ROOM_TYPE_LENGTH)
    return F.coalesce(F.nullif(head, F.lit("")), F.lit(fv.DEFAULT_ROOM))


def capacity(description: Column | str) -> Column:
    """Capacity class of a room description; the first class in the fixed order wins.

    Plain substring matching: ``11인`` holds ``1인`` and therefore gives the one-guest class.
    Use :func:`capacity_n` for the number actually written.
    """
    column = as_column(description)
    (label, words), *others = fv.CAPACITY_WORDS
    result = F.when(contains_any(column, words), label)
    for label, words in others:
        result = result.when(contains_any(column, words), label)
    return result.otherwise(fv.DEFAULT_CAPACITY)


def capacity_n(description: Column | str) -> Column:
    """Number of guests written in a room description, NULL if none is."""
    digits = first_match(description, r"(?U)(?<!\d)(\d+)인", 1)
    return ascii_digits(digits).try_cast("int")


def int_or(text: Column | str, default: int = fv.DEFAULT_ADULTS) -> Column:
    """The text as INT if it is digits only, else the default (so ``-3`` gives the default)."""
    digits = first_match(ascii_digits(strip(text)), r"^[0-9]+$")
    return F.coalesce(digits.try_cast("int"), F.lit(default))


def match_key(name: Column | str) -> Column:
    """Lodging name without case, white space and punctuation: the cross-platform match key."""
    return F.lower(F.regexp_replace(as_column(name), r"(?U)[\s\p{P}]+", ""))


def has_match_key(name: Column | str) -> Column:
    """Whether the match key is not empty. Ends at the first character that counts, so it is cheap to filter by."""
    return as_column(name).rlike(r"(?U)[^\s\p{P}]")
