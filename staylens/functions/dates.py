"""Date functions of a stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.functions.text import as_column, first_match


def stay_date(text: Column | str) -> Column:
    """Date of a ``year-month-day`` text, one-digit months and days included; NULL if invalid."""
    # The date format alone would accept longer numbers.
    valid = first_match(text, r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")
    return F.try_to_date(valid, "yyyy-M-d")


def korean_date(date: Column | str) -> Column:
    """Date label without zero padding, such as ``2025년 8월 2일``."""
    return F.date_format(as_column(date), "yyyy'년' M'월' d'일'")


def months_ahead(date: Column | str, as_of: Column | str) -> Column:
    """Calendar months from one date to a later one, days ignored; never negative, NULL for NULL."""
    later, earlier = as_column(date), as_column(as_of)
    months = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    return F.when(months > 0, months).when(months <= 0, 0)


def nights(check_in: Column | str, check_out: Column | str) -> Column:
    """Nights of a stay, NULL unless the check-out is after the check-in."""
    days = F.datediff(as_column(check_out), as_column(check_in))
    return F.when(days > 0, days)


def price_per_night(
    price: Column | str, check_in: Column | str, check_out: Column | str
) -> Column:
    """Price of a whole stay divided by its nights, NULL for an invalid stay."""
    return as_column(price).cast("double") / nights(check_in, check_out)
