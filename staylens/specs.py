"""Where the fields of a page are: one specification per platform and page kind."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from staylens import fixed_values as fv
from staylens.functions.markup import Field, Group


@dataclass(frozen=True)
class CardSpec:
    """Listings that are one element each. A card without a required field is left out."""

    source: str
    card: str
    fields: Mapping[str, Field | Group]
    required: tuple[str, ...] = ()
    next_page: str | None = None


@dataclass(frozen=True)
class ListSpec:
    """Listings whose fields are page-wide lists, matched by position."""

    source: str
    lists: Mapping[str, Field | Group]


@dataclass(frozen=True)
class KeywordSpec:
    """Ranked keywords of a page: by selector, or by pattern where the markup is flat.

    A pattern stays inside Catalyst; its first group is the keyword. With ``section``, only the
    first element that selector finds is searched.
    """

    source: str
    selector: str | None = None
    section: str | None = None
    pattern: str | None = None
    text: str = "nodes"
    distinct: bool = False


def _trivago() -> CardSpec:
    at = fv.TRIVAGO_SELECTORS
    return CardSpec(
        source=fv.TRIVAGO,
        card=at["card"],
        fields={
            "name": Field(at["name"]),
            "location": Field(at["location"]),
            "rating": Field(at["rating"]),
            "lodging_type": Field(at["lodging_type"]),
            "price": Field(at["price"]),
        },
        required=("name", "location", "rating"),
        next_page=at["next_page"],
    )


def _yanolja() -> CardSpec:
    at = fv.YANOLJA_SELECTORS
    return CardSpec(
        source=fv.YANOLJA,
        card=at["card"],
        fields={
            "link": Field("", attr="href"),
            "name": Field(at["name"], text="rendered"),
            "lodging_type": Field(at["lodging_type"], text="rendered"),
            "location": Field(at["location"], text="rendered"),
            "rating": Field(at["rating"], text="rendered"),
            "prices": Field(at["price"], text="rendered", many=True),
            "rooms": Group(
                at["room"],
                {
                    "description": Field(at["room_text"], text="rendered"),
                    "prices": Field(at["room_price"], text="rendered", many=True),
                },
            ),
            "status_texts": Field("*", text="own", many=True),
        },
    )


def _yeogi(leaf: bool) -> ListSpec:
    at = fv.YEOGI_SELECTORS
    return ListSpec(
        source=fv.YEOGI,
        lists={
            "name": Field(at["name"], many=True),
            "lodging_type": Field(at["lodging_type"], many=True),
            "location": Group(at["location"], {"spans": Field("span", many=True, leaf=leaf)}),
            "rating": Field(at["rating"], many=True),
            "price": Group(
                at["price"], {"spans": Field("span", text="nodes", many=True, leaf=leaf)}
            ),
            "link": Field(at["link"], attr="href", many=True),
        },
    )


TRIVAGO_CARDS = _trivago()
YANOLJA_CARDS = _yanolja()
YEOGI_LISTS = _yeogi(leaf=False)
#: Same lists, but nested spans do not repeat their text.
YEOGI_LISTS_LEAF = _yeogi(leaf=True)

TRIVAGO_KEYWORDS = KeywordSpec(fv.TRIVAGO, fv.TRIVAGO_SELECTORS["keyword"], distinct=True)
YANOLJA_KEYWORDS = KeywordSpec(fv.YANOLJA, fv.YANOLJA_SELECTORS["keyword"])
YEOGI_KEYWORDS = KeywordSpec(
    fv.YEOGI,
    fv.YEOGI_SELECTORS["keyword"],
    section=fv.YEOGI_SELECTORS["keyword_section"],
    text="rendered",
)
ALL_KEYWORDS = (TRIVAGO_KEYWORDS, YANOLJA_KEYWORDS, YEOGI_KEYWORDS)
