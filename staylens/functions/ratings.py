"""Rating functions. Ratings are DECIMAL, so rounding is half-up on the written digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.functions.text import as_column, ascii_digits, first_match


def _number(text: Column, pattern: str) -> Column:
    """First match of a pattern as an exact number."""
    return ascii_digits(first_match(text, pattern)).try_cast("decimal(38,18)")


def rating_x2(text: Column | str) -> Column:
    """Rating out of 5 as text out of 10 with one decimal.

    A text without a decimal number is returned as it is (``5`` stays ``5``); NULL stays NULL.
    """
    column = as_column(text)
    doubled = F.round(_number(column, fv.DECIMAL_NUMBER) * F.lit(2), 1)
    return F.coalesce(doubled.cast("string"), column)


def rating10(text: Column | str, source: Column | str) -> Column:
    """Numeric rating out of 10. One platform rates out of 5; its integers are doubled too."""
    factor = F.when(as_column(source) == fv.YANOLJA, 2).otherwise(1)
    number = _number(as_column(text), r"(?U)\d+(?:\.\d+)?")
    return F.round(number * factor, 1).try_cast("decimal(5,1)")
