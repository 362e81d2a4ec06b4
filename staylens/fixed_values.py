"""Values that results must carry exactly: labels, sentinels, patterns, selectors.

Everything in this module is data. Code elsewhere refers to it by name.
"""

# Platform labels of the ranking table.
TRIVAGO = "Trivago"
YANOLJA = "Yanolja"
YEOGI = "Yeogi"

# Column headers of the listing files.
LISTING_HEADERS = {
    "name": "숙소명",
    "lodging_type": "숙소유형",
    "location": "위치",
    "rating_raw": "평점",
    "price_raw": "가격",
    "link": "링크",
}

# Column headers of the ranking file.
RANKING_HEADERS = {"source": "Source", "rank": "Rank", "region": "Region"}

# Texts written where a listing field is missing, per platform.
SENTINELS = {
    TRIVAGO: {
        "lodging_type": "유형 정보 없음",
        "price_raw": "가격 정보 없음",
    },
    YANOLJA: {
        "name": "N/A",
        "lodging_type": "N/A",
        "location": "N/A",
        "rating_raw": "평점 없음",
        "price_raw": "가격 정보 없음",
        "link": "링크 없음",
    },
    YEOGI: {
        "price_raw": "없음",
        "link": "없음",
    },
}

# Labels of price, room and report fields.
WON = "원"
PER_NIGHT = "1박 기준"
PER_NIGHT_SUFFIX = "/1박"
SOLD_OUT = "예약마감"
FAILED = "오류"
NO_PRICE = "가격 정보 없음"
DEFAULT_ROOM = "기본객실"
DEFAULT_CAPACITY = "2인실"
NO_DATA = "데이터 없음"
DEFAULT_ADULTS = 2
DEFAULT_CHILDREN = 0
ROOM_TYPE_LENGTH = 30

# Texts that mark a listing as not bookable.
SOLD_OUT_WORDS = ("예약마감", "판매가", "매진")
# Same, without the word that also means "sale price".
SOLD_OUT_WORDS_STRICT = ("예약마감", "매진")

# Capacity class by the first matching word, in this order.
CAPACITY_WORDS = (
    ("1인실", ("1인", "싱글")),
    ("2인실", ("2인", "더블")),
    ("3인실", ("3인", "트리플")),
    ("4인실", ("4인", "쿼드")),
    ("5인실", ("5인",)),
    ("6인실", ("6인",)),
)

# Patterns. (?U) makes \d match every Unicode decimal digit.
NUMBER_RUN = r"(?U)[\d,]+"
DECIMAL_NUMBER = r"(?U)\d+\.\d+"

# Unicode white space removed from both ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Hosts, the search address and file names.
YEOGI_HOST = "https://www.yeogi.com"
YEOGI_SEARCH = (
    "https://www.yeogi.com/domestic-accommodations?keyword={query}&checkIn={check_in}"
    "&checkOut={check_out}&personal={adults}&freeForm=false&page={page}"
)
LISTING_FILE_NAMES = {
    TRIVAGO: "trivago_{query}.csv",
    YANOLJA: "yanolja_{query}.csv",
    YEOGI: "{query_underscored}_yeogi.csv",
}

# Platforms whose files have a link column, and those that write a header without rows.
WITH_LINK = (YANOLJA, YEOGI)
HEADER_ALWAYS = (YEOGI,)

# Selectors of the card platform.
TRIVAGO_SELECTORS = {
    "card": 'article[data-testid="item"]',
    "name": 'span[itemprop="name"]',
    "location": 'button[data-testid="distance-label-section"] span',
    "rating": 'span[itemprop="ratingValue"]',
    "lodging_type": 'button[data-testid="accommodation-type"]',
    "price": 'div[data-testid="recommended-price"]',
    "next_page": 'button[data-testid="next-result-page"]',
    "keyword": 'button[data-testid="apd-destination-button"]',
}

# Selectors of the platform whose listings hold rooms.
YANOLJA_SELECTORS = {
    "card": "a[href*='place-site.yanolja.com/places/']",
    "name": "p.typography-subtitle-16-bold",
    "lodging_type": "p.text-text-neutral-sub.typography-body-12-regular",
    "location": "span.line-clamp-1.text-start",
    "rating": "span.typography-body-14-bold",
    "price": "span.typography-subtitle-18-bold",
    "room": "div.flex.flex-col.gap-6.rounded-8.bg-fill-neutral-weak.px-8.py-8",
    "room_text": "span.line-clamp-1.text-start.text-text-neutral-sub.typography-body-12-regular",
    "room_price": "span.typography-subtitle-18-bold",
    "keyword": "span.PopularSearchList_keyword__1LfLt",
}

# Selectors of the platform read as parallel lists.
YEOGI_SELECTORS = {
    "name": "h3.gc-thumbnail-type-seller-card-title",
    "lodging_type": "ul.css-bl7zf6 li:first-child",
    "location": "div.css-19li9i9",
    "rating": "div.css-19f645y span.css-9ml4lz",
    "price": "div.css-yeouz0",
    "link": "a.gc-thumbnail-type-seller-card",
    "keyword_section": 'section[aria-label="인기 검색 키워드"]',
    "keyword": "div.css-grswmc > a",
}

# Cuisines offered near a lodging, and the word that marks a festival post.
CUISINES = ("한식", "중식", "일식", "양식")
FESTIVAL_WORD = "축제"
FESTIVAL_YEAR = 2025
