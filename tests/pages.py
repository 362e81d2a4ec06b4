"""Hand-written pages of the three platforms, with unclosed tags and entities."""

from __future__ import annotations


def card(name=None, place=None, rating=None, kind=None, price=None):
    parts = []
    if name is not None:
        parts.append(f'<span itemprop="name"> {name} </span>')
    if place is not None:
        parts.append(
            f'<button data-testid="distance-label-section"><i></i><span>{place}</span></button>'
        )
    if rating is not None:
        parts.append(f'<span itemprop="ratingValue">{rating}</span>')
    if kind is not None:
        parts.append(f'<button data-testid="accommodation-type">{kind}</button>')
    if price is not None:
        parts.append(f'<div data-testid="recommended-price"><b>{price}</b></div>')
    return f'<article data-testid="item"><p>새로운<br>{"".join(parts)}</article>'


def card_page(*cards, button='<button data-testid="next-result-page" class="pager">다음</button>'):
    return (
        "<!DOCTYPE html><html><head><script>var a='<article data-testid=\"item\">';</script>"
        f"</head><body><!-- {len(cards)} -->{''.join(cards)}{button}</body>"
    )


ENABLED = '<button data-testid="next-result-page" class="pager">다음</button>'
DISABLED_CLASS = '<button data-testid="next-result-page" class="pager is-disabled">다음</button>'
DISABLED = '<button data-testid="next-result-page" class="pager" disabled>다음</button>'


def room(text=None, price=None):
    inner = ""
    if text is not None:
        inner += (
            '<span class="line-clamp-1 text-start text-text-neutral-sub typography-body-12-regular">'
            f"{text}</span>"
        )
    if price is not None:
        inner += f'<span class="typography-subtitle-18-bold">{price}</span>'
    return f'<div class="flex flex-col gap-6 rounded-8 bg-fill-neutral-weak px-8 py-8">{inner}</div>'


def listing(key, name="호텔 &amp; 스파", rating="4.43", price=None, rooms=(), status=None):
    parts = [f'<p class="typography-subtitle-16-bold">{name}</p>'] if name is not None else []
    parts.append('<p class="text-text-neutral-sub typography-body-12-regular">호텔</p>')
    parts.append('<span class="line-clamp-1 text-start">부산\n 해운대구</span>')
    if rating is not None:
        parts.append(f'<span class="typography-body-14-bold">{rating}</span>')
    if price is not None:
        parts.append(f'<span class="typography-subtitle-18-bold">{price}</span>')
    if status is not None:
        parts.append(f"<div><em>{status}</em></div>")
    parts.extend(rooms)
    return f'<a href="https://place-site.yanolja.com/places/{key}">{"".join(parts)}</a>'


def row_page(names=(), kinds=None, places=None, ratings=None, prices=None, links=None):
    def given(values):
        return names if values is None else values

    return "".join(
        [
            *(f'<h3 class="gc-thumbnail-type-seller-card-title x"> {v} </h3>' for v in names),
            *(f'<ul class="css-bl7zf6"><li>{v}</li><li>기타</li></ul>' for v in given(kinds)),
            *(f'<div class="css-19li9i9"><span>{v}</span><i><span> 역</span></i></div>'
              for v in given(places)),
            *(f'<div class="css-19f645y"><span class="css-9ml4lz">{v}</span></div>'
              for v in given(ratings)),
            *(f'<div class="css-yeouz0"><span>{v}</span><span> 원 </span><span>/1박</span></div>'
              for v in given(prices)),
            *(f'<a class="gc-thumbnail-type-seller-card" href="{v}"></a>' for v in given(links)),
        ]
    )
