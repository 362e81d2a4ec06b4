"""Search addresses, links and output names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.functions.dates import stay_date
from staylens.functions.text import as_column


def _filled(template: str, values: dict[str, Column]) -> Column:
    """Concatenation of a template's literal parts and the named columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(
        *[
            values[part].cast("string") if index % 2 else F.lit(part)
            for index, part in enumerate(parts)
            if part
        ]
    )


def absolute_url(base: Column | str, href: Column | str) -> Column:
    """Base followed by a relative link; an absolute link as it is; NULL for an empty one."""
    link = F.nullif(as_column(href), F.lit(""))
    base_column = F.lit(base) if isinstance(base, str) else base
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).otherwise(
        F.concat(base_column, link)
    )


def search_url(
    query: Column | str,
    check_in: Column | str,
    check_out: Column | str,
    adults: Column | str,
    page: Column | str,
    encode: bool = False,
) -> Column:
    """Search address of a request. Only spaces are replaced, unless ``encode`` is set."""
    keyword = as_column(query)
    keyword = F.url_encode(keyword) if encode else F.replace(keyword, F.lit(" "), F.lit("+"))
    return _filled(
        fv.YEOGI_SEARCH,
        {
            "query": keyword,
            "check_in": as_column(check_in),
            "check_out": as_column(check_out),
            "adults": as_column(adults),
            "page": as_column(page),
        },
    )


def _asked(url: Column | str) -> Column:
    """``key=value`` parts of an address; parse_url would reject one with a raw space."""
    return F.split(F.regexp_extract(as_column(url), r"^[^?#]*\?([^#]*)", 1), "&")


def _value(parts: Column, key: str) -> Column:
    first = F.get(F.filter(parts, lambda part: part.startswith(f"{key}=")), F.lit(0))
    return F.try_url_decode(F.substring(first, len(key) + 2, 2**31 - 1))


def url_parameter(url: Column | str, key: str) -> Column:
    """Decoded query parameter of an address, NULL if it is absent or cannot be decoded."""
    return _value(_asked(url), key)


def request_from_url(url: Column | str) -> Column:
    """Request a search address was made for: query, dates, guests and page number."""

    def request(parts: Column) -> Column:
        return F.struct(
            _value(parts, "keyword").alias("query"),
            stay_date(_value(parts, "checkIn")).alias("check_in"),
            stay_date(_value(parts, "checkOut")).alias("check_out"),
            _value(parts, "personal").try_cast("int").alias("adults"),
            _value(parts, "page").try_cast("int").alias("page_no"),
        )

    # A one-element array, so that the address is split once for all five.
    return F.get(F.transform(F.array(_asked(url)), request), F.lit(0))


def output_key(query: Column | str, source: Column | str) -> Column:
    """File name of one query's listings; the three platforms name theirs differently."""
    text, platform = as_column(query), as_column(source)
    values = {
        "query": text,
        "query_underscored": F.replace(text, F.lit(" "), F.lit("_")),
    }
    result = None
    for name, template in fv.LISTING_FILE_NAMES.items():
        filled = _filled(template, values)
        result = F.when(platform == name, filled) if result is None else result.when(
            platform == name, filled
        )
    return result
