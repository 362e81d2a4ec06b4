"""Pages to rows, on hand-written pages."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pages as html
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from staylens import fixed_values as fv
from staylens.functions import markup
from staylens import schemas
from staylens.functions.markup import Field, Group, read_markup
from staylens.operators.extract import aligned, extract_keywords, keyword_list, page_prefix
from staylens.operators.listings import compat_view
from staylens.plans import all_listings, card_listings, list_listings, rankings, room_listings
from staylens.specs import TRIVAGO_KEYWORDS, YANOLJA_KEYWORDS, YEOGI_KEYWORDS

AT = dt.datetime(2025, 8, 1)


def captures(spark, source, *pages, request="r1"):
    rows = [(source, request, n, AT, f"u{n}", page) for n, page in enumerate(pages, 1)]
    return spark.createDataFrame(rows, schemas.CAPTURES)


def read(spark, page, shape):
    frame = spark.createDataFrame([(page,)], "h string")
    return frame.select(read_markup("h", shape).alias("m")).first().m


def test_text_modes(spark):
    page = "<p><b> 서울 </b> <i>강남</i>\n&amp; <!-- x -->c<script>no</script>"
    m = read(spark, page, {
        "outer": Field("p"), "nodes": Field("p", text="nodes"),
        "rendered": Field("p", text="rendered"), "own": Field("p", text="own"),
        "missing": Field("h1"), "empty": Field("script"),
    })
    assert m.outer == "서울  강남\n& c"
    assert m.nodes == "서울강남&c"
    assert m.rendered == "서울 강남 & c"
    assert m.own == " "
    assert m.missing is None and m.empty == "" and m.error is None


def test_selectors(spark):
    page = (
        '<div class="a b" data-k="x"><ul><li id=1>1<li id=2>2</ul><a href="/in">in</a></div>'
        '<div class="a"><section><a>deep</a></section><br><a href>last</a></div>'
    )
    m = read(spark, page, {
        "both": Field("div.a.b", attr="data-k", many=True),
        "first": Field("ul li:first-child", attr="id", many=True),
        "child": Field("div.a > a", many=True),
        "any": Field("div a", many=True),
        "exact": Field('div[data-k="x"] a', many=True),
        "part": Field("a[href*='/i']", many=True),
        "present": Field("a[href]", attr="href", many=True),
        "group": Group("div", {"links": Field("a", many=True), "k": Field("", attr="data-k")}),
    })
    assert m.both == ["x"] and m.first == ["1", "2"]  # an unclosed item holds the next one
    assert m.child == ["in", "last"]
    assert m.any == ["in", "deep", "last"]
    assert m.exact == ["in"] and m.part == ["in"] and m.present == ["/in", ""]
    assert [(g.links, g.k) for g in m.group] == [(["in"], "x"), (["deep", "last"], "")]


def test_unsupported_selector_is_refused(spark):
    with pytest.raises(Exception, match="selector not supported"):
        read(spark, "<p>", {"x": Field("p + b")})


def test_null_page(spark):
    frame = spark.createDataFrame([(None,)], "h string")
    assert frame.select(read_markup("h", {"a": Field("a")}).alias("m")).first().m is None


def test_cards(spark):
    page = html.card_page(
        html.card("A", "서울", "8.7", "호텔", "약 54,000 원"),
        html.card("B", "서울", None, "호텔", "1원"),
        html.card("C", "부산", "9.1"),
        html.card("D", "", "9", "모텔", ","),
        button="",
    )
    frame = captures(spark, fv.TRIVAGO, page)
    rows = card_listings(frame).orderBy("item_pos").collect()
    assert [(r.name, r.location, r.rating_raw, r.price_raw, r.price_krw) for r in rows] == [
        ("A", "서울", "8.7", "54,000원", 54000),
        ("C", "부산", "9.1", None, None),
        ("D", "", "9", ",원", None),
    ]
    compat = compat_view(card_listings(frame), link=False).collect()
    assert compat[1].asDict() == {
        "숙소명": "C", "숙소유형": "유형 정보 없음", "위치": "부산", "평점": "9.1", "가격": "가격 정보 없음",
    }
    everything = card_listings(frame, keep_incomplete=True).orderBy("item_pos").collect()
    assert [r.name for r in everything] == ["A", "B", "C", "D"] and everything[1].rating10 is None


@pytest.mark.parametrize(
    ("button", "expected"),
    [
        (html.ENABLED, ["A", "B", "C"]),
        (html.DISABLED_CLASS, ["A", "B"]),
        (html.DISABLED, ["A", "B"]),
        ("", ["A", "B"]),
    ],
)
def test_last_page(spark, button, expected):
    cards = [html.card(n, "서울", "9") for n in "ABC"]
    frame = captures(
        spark, fv.TRIVAGO, html.card_page(cards[0]), html.card_page(cards[1], button=button),
        html.card_page(cards[2]),
    )
    assert [r.name for r in card_listings(frame).orderBy("page_no").collect()] == expected


def test_rooms(spark):
    page = "<div>" + "".join([
        html.listing(1, price="50,000원", rooms=[
            html.room("더블 2인", "60,000원"), html.room("패밀리 4인", "10% 70,000원"), html.room()]),
        html.listing(2, price="80,000", rooms=[html.room("싱글")]),
        html.listing(3, name=None, rating=None, price="무료"),
        html.listing(4, rating="5", status="오늘 매진"),
        html.listing(5, rating="신규", price="90,000원", status="판매가"),
    ])
    rows = room_listings(captures(spark, fv.YANOLJA, page)).orderBy("item_pos", "room_pos").collect()
    assert [(r.item_pos, r.room_pos, r.room_type, r.capacity, r.price_raw, r.price_krw) for r in rows] == [
        (0, 0, "더블 2인", "2인실", "60000", 60000),
        (0, 1, "패밀리 4인", "4인실", "10", 70000),
        (1, 0, "싱글", "1인실", "80000", 80000),
        (2, 0, "기본객실", "2인실", None, None),
        (3, 0, "기본객실", "2인실", "예약마감", None),
        (4, 0, "기본객실", "2인실", "예약마감", 90000),
    ]
    assert [r.rating_raw for r in rows] == ["8.9", "8.9", "8.9", None, "5", "신규"]
    assert rows[4].rating10 == Decimal("10.0") and rows[4].price_basis == "예약마감"
    assert [r.available for r in rows] == [True, True, True, True, False, True]
    assert rows[0].name == "호텔 & 스파" and rows[0].location == "부산 해운대구"
    assert rows[0].link == "https://place-site.yanolja.com/places/1"
    compat = compat_view(room_listings(captures(spark, fv.YANOLJA, page))).collect()
    third = next(r for r in compat if r["링크"].endswith("/3"))
    assert (third["숙소명"], third["평점"], third["가격"]) == ("N/A", "평점 없음", "가격 정보 없음")


def test_lists(spark):
    full = html.row_page(["A", "B", "C"], links=["/a", "", "https://h/c"], prices=["54,000", "1", "2"])
    short = html.row_page(["D", "E", "F"], ratings=["9.1", "8.0"])
    frame = captures(spark, fv.YEOGI, full, short, html.row_page(), html.row_page(["G"]))
    rows = list_listings(frame).orderBy("page_no", "item_pos").collect()
    assert [r.name for r in rows] == ["A", "B", "C", "D", "E"]
    assert (rows[0].location, rows[0].price_raw, rows[0].price_krw) == ("A 역", "54,000원/1박", 54000)
    assert [r.link for r in rows[:3]] == ["https://www.yeogi.com/a", None, "https://h/c"]
    assert rows[0].price_basis == "1박 기준" and rows[0].lodging_type == "A"


def test_nested_spans_repeat_unless_leaf(spark):
    page = html.row_page(["A"]).replace("<span>A</span>", "<span>A<span>x</span></span>", 1)
    frame = captures(spark, fv.YEOGI, page)
    assert list_listings(frame).first().location == "Ax x 역"
    assert list_listings(frame, leaf_spans=True).first().location == "x 역"


def test_all_listings(spark):
    frame = captures(spark, fv.TRIVAGO, html.card_page(html.card("A", "서울", "9"))).union(
        captures(spark, fv.YANOLJA, html.listing(1))
    ).union(captures(spark, fv.YEOGI, html.row_page(["B"])))
    found = all_listings(frame)
    assert sorted((r.source, r.name) for r in found.collect()) == [
        (fv.TRIVAGO, "A"), (fv.YANOLJA, "호텔 & 스파"), (fv.YEOGI, "B")]
    assert ", ".join(f"{n} {t}" for n, t in found.dtypes) == schemas.LISTINGS


WORDS = ["서울", "부산", " 서울 ", " ", "제주"]


def test_rankings(spark):
    by_attribute = "".join(f'<button data-testid="apd-destination-button">{w}</button>' for w in WORDS)
    by_class = "".join(f'<span class="x PopularSearchList_keyword__1LfLt">{w}</span>' for w in WORDS)
    in_section = (
        '<a>밖</a><div class="css-grswmc"><a>밖</a></div><section aria-label="인기 검색 키워드">'
        '<div class="css-grswmc"><a>서울</a><b><a>아님</a></b><a> 부산</a></div></section>'
        '<section aria-label="인기 검색 키워드"><div class="css-grswmc"><a>둘째</a></div></section>'
    )
    frame = captures(spark, fv.TRIVAGO, by_attribute).union(
        captures(spark, fv.YANOLJA, by_class)).union(captures(spark, fv.YEOGI, in_section))
    found = {}
    for r in rankings(frame).orderBy("source", "rank").collect():
        found.setdefault(r.source, []).append((r["rank"], r.region))
    assert found == {
        fv.TRIVAGO: [(1, "서울"), (2, "부산"), (3, "제주")],
        fv.YANOLJA: [(1, "서울"), (2, "부산"), (3, "서울"), (4, "제주")],
        fv.YEOGI: [(1, "서울"), (2, "부산")],
    }


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["서울", "부산", " ", "제주 ", "제주", "a&b"]), max_size=12))
def test_distinct_keywords_keep_their_order(spark, words):
    page = "".join(
        f'<button data-testid="apd-destination-button">{w.replace("&", "&amp;")}</button>' for w in words
    )
    frame = spark.createDataFrame([(page,)], "html string")
    stripped = [w.strip() for w in words if w.strip()]
    got = frame.select(keyword_list(TRIVAGO_KEYWORDS)).first()[0]
    assert got == list(dict.fromkeys(stripped))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 5), min_size=3, max_size=3))
def test_zip_is_as_long_as_the_shortest(spark, sizes):
    frame = spark.createDataFrame(
        [tuple([f"{c}{i}" for i in range(n)] for c, n in zip("abc", sizes))],
        "a array<string>, b array<string>, c array<string>",
    )
    zipped = frame.select(aligned({"a": "a", "b": "b", "c": "c"})).first()[0]
    assert [tuple(z) for z in zipped] == [(f"a{i}", f"b{i}", f"c{i}") for i in range(min(sizes))]


def test_page_prefix(spark):
    pages = [("stop", 1, 3), ("stop", 2, 0), ("stop", 3, 5), ("never", 1, 1), ("never", 4, 2),
             ("first", 1, 0), ("first", 2, 9), ("broken", 1, 2), ("broken", 2, None), ("broken", 3, 1)]
    frame = spark.createDataFrame(pages, "request_id string, page_no int, n_items int")
    kept = {tuple(r) for r in page_prefix(frame).collect()}
    assert kept == {pages[0], pages[3], pages[4], pages[7], pages[8], pages[9]}


def test_keyword_specs_differ_in_distinct():
    assert TRIVAGO_KEYWORDS.distinct and not YANOLJA_KEYWORDS.distinct and not YEOGI_KEYWORDS.distinct


def test_extract_keywords_positions(spark):
    page = "<button data-testid='apd-destination-button'>x</button>" * 2
    rows = extract_keywords(captures(spark, fv.TRIVAGO, page), TRIVAGO_KEYWORDS).collect()
    assert [(r.pos, r.region) for r in rows] == [(0, "x")]


_PIECES = (
    "<p>", "</p>", '<div class="a b">', "</div>", '<a href="x&amp;y">', "<a href='q'>", '<A HREF="Z" href="y">', "</a >", "<br>",
    "<br/>", "<img src=x>", "text", "a > b", " ", "\n", "  \t", "&amp;", "&lt", "&#65;", "& b", "&", "<script>if(a<b){x>y}</script>",
    "<script>", "</script>", "<style>p{a>b}</style>", "<title>T &amp; <b>x</b></title>", "<textarea> <p> </textarea>", "<pre>",
    "</pre>", " \n ", "<!-- c > d -->", "<!--", "-->", "<!DOCTYPE html>", "<?pi x>", "</>", "</ b>", "< p", "<", "<1>", "<p",
    '<p class="', '"', "'", "<svg><p/></svg>", "<li >", "</li>", "<noscript><p>", "</noscript>", "<plaintext>", "é", "<![CDATA[x]]>",
    "<!x>", '<P\tid="1"\n>', '<p id="a>b">', '<p a="&lt;">',
)


def test_plain_tags_are_taken_as_the_standard_parser_takes_them(monkeypatch):
    """What is taken at once gives the same elements, attributes and texts as the parser alone."""
    rng = random.Random(1)
    pages = ["".join(rng.choices(_PIECES, k=rng.randint(0, 25))) for _ in range(5000)]

    def seen(html):
        try:
            page = markup._Page(html)
        except AssertionError as error:
            return str(error)
        return page.tags, [dict(a) for a in page.attrs], page.parents, page.is_first, page.spans, page.texts, page.own_text

    found = [seen(html) for html in pages]
    monkeypatch.setattr(markup._Page, "_take", markup._Page.feed)
    assert found == [seen(html) for html in pages]


def test_a_tag_written_alike_is_taken_apart_once(monkeypatch):
    """Names, attributes and selectors are looked at once for each way a tag is written, whatever the pages."""
    seen = []
    tag = markup._Selectors.tag
    monkeypatch.setattr(markup._Selectors, "tag", lambda self, written: seen.append(written) or tag(self, written))
    values = markup._column(markup.Field("div.a > span:first-child", many=True))
    selectors = markup._Selectors([values])
    for n in range(50):
        page = markup._Page(f'<div class="a x"><span>{n}</span><span>no</span></div><div><span>no</span></div>', selectors)
        values.add(page, -1)
    assert values.values == [str(n) for n in range(50)]
    assert sorted(seen) == sorted(['div class="a x"', "span", "/span", "/div", "div"])
    monkeypatch.setattr(markup, "_KNOWN_TAGS", 2)
    values.add(markup._Page('<p><i><b><u><div class="a"><span>50</span></div>', selectors), -1)
    assert values.values[-1] == "50" and len(selectors.known) <= 5


def test_attributes_are_kept_where_a_selector_needs_them(spark):
    """Each kind of selector and attribute, with and without tags of its own, in one reading."""
    html = '<ul id="u"><li class="x y" title="t"><a href="1">a</a></li><li><b data-k="v w">b</b></li></ul>'
    group = lambda selector, **fields: markup.Group(selector, fields)
    field = markup.Field
    shapes = [
        ({"a": field("li.x a", attr="href")}, {"a": "1"}),
        ({"a": field("li a", attr="href"), "g": group("li", k=field("b", attr="data-k"))}, {"a": "1", "g": [{"k": None}, {"k": "v w"}]}),
        ({"g": group("li", t=field("", attr="title"))}, {"g": [{"t": "t"}, {"t": ""}]}),
        ({"a": field("[data-k*='w']")}, {"a": "b"}),
        ({"a": field("ul > *", attr="class", many=True)}, {"a": ["x y", ""]}),
    ]
    frame = spark.createDataFrame([(1, html), (2, None), (3, "<ul>")], "n int, html string")
    for shape, expected in shapes:
        rows = frame.select("n", markup.read_markup("html", shape).alias("page")).orderBy("n").collect()
        assert rows[0].page.asDict(recursive=True) == expected | {"error": None}
        assert rows[1].page is None
        assert all(not value for value in rows[2].page.asDict().values())
