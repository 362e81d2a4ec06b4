"""Sources and sinks, streams included."""

from __future__ import annotations

import csv
import datetime as dt
import io
from pathlib import Path

import pages as html
import pytest

from staylens import fixed_values as fv
from staylens import schemas
from staylens.operators.listings import compat_view
from staylens.operators.ranking import source_report
from staylens.plans import (
    card_listings,
    list_listings,
    listing_files,
    query_files,
    rankings,
    rankings_of_sources,
    requests_from_captures,
    room_listings,
    with_defaults,
)
from staylens.sources import (
    clear_stored,
    durable,
    read_captures,
    read_newest_captures,
    read_sources,
    release,
    shared_folder,
    write_listing_files,
    write_listings,
    write_listings_csv,
    write_rankings_csv,
)
from staylens.sources import captures as source_of_captures
from staylens.streaming import stream_captures, stream_rooms, write_arrivals

HEADERS = "source string, query string, `숙소명` string, `가격` string"


def captures(spark, source=fv.YANOLJA, page=None, request="r1"):
    page = html.listing(1, price="9,000") if page is None else page
    return spark.createDataFrame(
        [(source, request, 1, dt.datetime(2025, 8, 1), "u", page)], schemas.CAPTURES)


def csv_files(path):
    return sorted(file for file in Path(path).rglob("*.csv") if file.is_file())


def test_captures_are_pruned(spark, tmp_path):
    path = str(tmp_path / "captures")
    captures(spark).union(captures(spark, fv.YEOGI, "x", "r2")).write.partitionBy("source").parquet(path)
    assert read_captures(spark, path).count() == 2
    one = read_captures(spark, path, [fv.YEOGI], ["r2"])
    assert [r.request_id for r in one.collect()] == ["r2"]
    plan = one._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(source" in plan and "EqualTo(request_id,r2)" in plan


def test_a_missing_source_leaves_the_others(spark, tmp_path):
    captures(spark).write.parquet(str(tmp_path / "a"))
    frame, status = read_sources(
        spark, {fv.YANOLJA: str(tmp_path / "a"), fv.YEOGI: str(tmp_path / "none")})
    assert status == {fv.YANOLJA: "ok", fv.YEOGI: "missing"}
    assert [r.source for r in frame.collect()] == [fv.YANOLJA]


def broken(tmp_path, *names):
    """Folders with a file that is no Parquet, one with another schema, and one damaged inside."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name in names:
        (tmp_path / name).mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"no parquet")
    pq.write_table(pa.table({"request_id": ["r"], "html": [1]}), tmp_path / "typed" / "x.parquet")
    # Plain pages of a known length, whose data is then overwritten: the footer stays sound.
    target = tmp_path / "damaged" / "x.parquet"
    table = pa.table({"source": ["s"], "request_id": ["r"], "page_no": pa.array([1], pa.int32()),
                      "captured_at": pa.array([0], pa.timestamp("us", "UTC")), "url": ["u"], "html": ["x" * 20_000]})
    pq.write_table(table, target, compression="zstd", use_dictionary=False)
    data = bytearray(target.read_bytes())
    data[4:200] = bytes(196)
    target.write_bytes(bytes(data))


def test_sources_that_cannot_be_read_leave_the_others(spark, tmp_path):
    broken(tmp_path, "bad", "typed", "damaged")
    page = "".join(f'<span class="PopularSearchList_keyword__1LfLt">{w}</span>' for w in ("서울", "부산"))
    captures(spark, fv.YANOLJA, page).write.parquet(str(tmp_path / "good"))
    for folder in ("bad", "typed", "none"):
        paths = {fv.YANOLJA: str(tmp_path / "good"), fv.YEOGI: str(tmp_path / folder)}
        frame, status = read_sources(spark, paths)
        assert status == {fv.YANOLJA: "ok", fv.YEOGI: "missing" if folder == "none" else "failed"}
        assert [r.source for r in frame.collect()] == [fv.YANOLJA]
        report = source_report(rankings(frame), paths, status)
        assert {(r.source, r.n, r.status) for r in report.collect()} == {
            (fv.YANOLJA, 2, "ok"), (fv.YEOGI, 0, status[fv.YEOGI])}


def test_damage_inside_a_file_leaves_the_other_rankings(spark, tmp_path):
    broken(tmp_path, "bad", "typed", "damaged")
    page = "".join(f'<span class="PopularSearchList_keyword__1LfLt">{w}</span>' for w in ("서울", "부산"))
    captures(spark, fv.YANOLJA, page).write.parquet(str(tmp_path / "good"))
    paths = {fv.TRIVAGO: str(tmp_path / "damaged"), fv.YANOLJA: str(tmp_path / "good"), fv.YEOGI: str(tmp_path / "typed")}
    found, report = rankings_of_sources(spark, paths)
    assert [(r.source, r["rank"], r.region) for r in found.orderBy("rank").collect()] == [
        (fv.YANOLJA, 1, "서울"), (fv.YANOLJA, 2, "부산")]
    assert {(r.source, r.n, r.status) for r in report.collect()} == {
        (fv.TRIVAGO, 0, "failed"), (fv.YANOLJA, 2, "ok"), (fv.YEOGI, 0, "failed")}
    nothing, report = rankings_of_sources(spark, {fv.YEOGI: str(tmp_path / "none")})
    assert nothing.collect() == [] and [(r.n, r.status) for r in report.collect()] == [(0, "missing")]


def test_newest_captures(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "captures")
    day = lambda n: None if n is None else dt.datetime(2025, 8, n)
    rows = [(fv.YEOGI, "r", 1, day(1), "u", "old"), (fv.YEOGI, "r", 1, day(3), "u", "new"), (fv.YEOGI, "r", 1, None, "u", "undated"),
            (fv.YEOGI, "r", 2, None, "u", "alone"), (fv.TRIVAGO, "r", 1, day(2), "u", "other"), (fv.YEOGI, None, 1, day(1), "u", "a"),
            (fv.YEOGI, None, 1, day(2), "u", "b"), (fv.TRIVAGO, "s", 1, day(5), "u", "same"), (fv.TRIVAGO, "s", 1, day(5), "u", "same")]
    spark.createDataFrame(rows, schemas.CAPTURES).repartition(4).write.partitionBy("source").parquet(path)
    expected = sorted(["new", "alone", "other", "b", "same"])
    found = read_newest_captures(spark, path)
    assert found.columns == read_captures(spark, path).columns
    assert sorted(r.html for r in found.collect()) == expected
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = found._jdf.queryExecution().explainString(mode)
    assert "BroadcastHashJoin LeftAnti" in plan
    # Pages are in no exchange: the only one is the broadcast of places.
    assert not any("html" in part for part in plan.split("Exchange")[1:] for part in [part.split("\n\n")[0]])
    assert "Exchange hashpartitioning" not in plan
    monkeypatch.setattr(source_of_captures, "SUPERSEDED_BYTES", 0)
    assert sorted(r.html for r in read_newest_captures(spark, path).collect()) == expected
    assert sorted(r.html for r in read_newest_captures(spark, path, [fv.YEOGI], ["r"]).collect()) == ["alone", "new"]


def test_files_as_the_platforms_write_them(spark, tmp_path):
    """Bytes of each platform's file, under its own name; files of other queries stay."""
    frame = captures(spark, fv.TRIVAGO, html.card_page(html.card("A, B", "서울", "9.1", None, "1,000"), html.card("C", "부산", "8", "호텔"))).union(
        captures(spark, fv.YANOLJA, html.listing(1, price="9,000", rooms=[html.room("2인 룸", "8,000"), html.room("스위트")]))).union(
        captures(spark, fv.YEOGI, html.row_page(["가", "나"], links=["/1", "/2"])))
    listings = card_listings(frame).unionByName(room_listings(frame)).unionByName(list_listings(frame))
    requests = spark.createDataFrame(
        [("r1", source, "부산 해운대/동", None, None, 2, 0) for source in (fv.TRIVAGO, fv.YANOLJA, fv.YEOGI)]
        + [("r2", fv.YEOGI, "빈 곳", None, None, 2, 0), ("r2", fv.TRIVAGO, "빈 곳", None, None, 2, 0)], schemas.REQUESTS)
    path = tmp_path / "files"
    path.mkdir()
    (path / "trivago_other.csv").write_bytes(b"kept")
    for _ in range(2):  # the second time over the first
        write_listing_files(listing_files(listings, requests), str(path), query_files(requests))
    visible = {f.name: f.read_bytes().decode("utf-8") for f in path.iterdir() if not f.name.startswith(".")}
    head, mark = "숙소명,숙소유형,위치,평점,가격", "\ufeff"
    place = "https://place-site.yanolja.com/places/1"
    assert visible == {
        "trivago_other.csv": "kept",
        "trivago_부산 해운대_동.csv": f'{mark}{head}\n"A, B",유형 정보 없음,서울,9.1,"1,000원"\nC,호텔,부산,8,가격 정보 없음\n',
        "yanolja_부산 해운대_동.csv": f"{mark}{head},링크\n호텔 & 스파,호텔,부산 해운대구,8.9,8000,{place}\n"
                                 f"호텔 & 스파,호텔,부산 해운대구,8.9,9000,{place}\n",
        "부산_해운대_동_yeogi.csv": f"{mark}{head},링크\n" + "".join(
            f"{n},{n},{n} 역,{n},{n}원/1박,https://www.yeogi.com/{i}\n" for i, n in enumerate("가나", 1)),
        "빈_곳_yeogi.csv": f"{mark}{head},링크\n",
    }


def test_a_listing_without_a_request_and_a_hot_query(spark, tmp_path):
    frame = captures(spark, fv.YEOGI, html.row_page([f"n{i}" for i in range(300)]), "r9")
    requests = spark.createDataFrame([], schemas.REQUESTS)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        write_listing_files(listing_files(list_listings(frame).repartition(9), requests), str(tmp_path / "hot"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in (tmp_path / "hot").iterdir() if f.suffix == ".csv"]
    lines = [line for f in files for line in f.read_text("utf-8-sig").splitlines()]
    assert all(f.name.startswith("r9_yeogi") for f in files)
    assert sorted(line.split(",")[0] for line in lines if not line.startswith("숙소명")) == sorted(f"n{i}" for i in range(300))
    assert sum(line.startswith("숙소명") for line in lines) == len(files)


def test_one_ranking_per_source(spark, tmp_path):
    page = lambda *names: "".join(f'<span class="PopularSearchList_keyword__1LfLt">{w}</span>' for w in names)
    rows = [(fv.YANOLJA, "r", n, dt.datetime(2025, 8, n), "u", page(f"a{n}", f"b{n}")) for n in (1, 2, 3)]
    found = rankings(spark.createDataFrame(rows, schemas.CAPTURES))

    def read(folder):
        return {f.name if folder == "others" else "all": f.read_text("utf-8-sig").splitlines()[1:]
                for f in csv_files(tmp_path / folder) if f.stat().st_size > 30}

    write_rankings_csv(found, str(tmp_path / "newest"), others=str(tmp_path / "others"))
    assert read("newest") == {"all": ["Yanolja,1,a3", "Yanolja,2,b3"]}
    assert read("others") == {f"Yanolja_r_{n}_2025080{n}T000000.csv": [f"Yanolja,1,a{n}", f"Yanolja,2,b{n}"] for n in (1, 2)}
    write_rankings_csv(found, str(tmp_path / "then"), at="2025-08-02 12:00:00")
    assert read("then") == {"all": ["Yanolja,1,a2", "Yanolja,2,b2"]}


def test_listing_csv_per_query(spark, tmp_path):
    rows = [(fv.YANOLJA, "부산", "호텔, A", "1"), (fv.YANOLJA, "제주", 'B "b"', "2"), (fv.YEOGI, "부산", "C", "3")]
    path = str(tmp_path / "csv")
    write_listings_csv(spark.createDataFrame(rows, HEADERS), path)
    files = csv_files(path)
    assert len(files) == 3
    for file in files:
        assert file.read_bytes().startswith("\ufeff숙소명,가격\n".encode())
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert {(r.source, r.query, r["숙소명"]) for r in back.collect()} == {r[:3] for r in rows}


def test_csv_is_written_as_by_the_csv_module(spark, tmp_path):
    rows = [(" a ", 'B "b", c'), ("", "x\ny"), ("일", "1,000원")]
    write_listings_csv(
        spark.createDataFrame(rows, "a string, b string").coalesce(1), str(tmp_path), (), False)
    (file,) = csv_files(tmp_path)
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\n").writerows([("\ufeffa", "b"), *rows])
    assert file.read_bytes().decode("utf-8") == buffer.getvalue()


def test_listings_to_one_folder_per_query(spark, tmp_path):
    url = fv.YEOGI_SEARCH.format(query="부산+해운대", check_in="2025-08-02", check_out="2025-08-04",
                                 adults=3, page=1)
    rows = [(fv.YEOGI, "r1", n, None, url.replace("page=1", f"page={n}"), html.row_page([f"A{n}"]))
            for n in (1, 2)]
    frame = spark.createDataFrame(rows, schemas.CAPTURES)
    requests = requests_from_captures(frame)
    assert [(r.query, r.check_in, r.adults, r.children) for r in requests.collect()] == [
        ("부산 해운대", dt.date(2025, 8, 2), 3, 0)]
    files = listing_files(list_listings(frame), requests)
    assert {r.file_name for r in files.collect()} == {"부산_해운대_yeogi.csv"}
    write_listings_csv(files, str(tmp_path / "q"), by=("source", "file_name"))
    (file,) = csv_files(tmp_path / "q")
    assert len(file.read_text("utf-8-sig").splitlines()) == 3
    empty = spark.createDataFrame([("r", "s", None, None)],
                                  "request_id string, source string, adults int, children int")
    assert tuple(with_defaults(empty).first())[2:] == (2, 0)


def test_empty_listings(spark, tmp_path):
    empty = spark.createDataFrame([], HEADERS)
    write_listings_csv(empty, str(tmp_path / "skipped"))
    assert csv_files(tmp_path / "skipped") == []
    write_listings_csv(empty, str(tmp_path / "kept"), skip_empty=False)
    (file,) = csv_files(tmp_path / "kept")
    assert file.read_bytes().decode("utf-8") == "\ufeff숙소명,가격\n"


def test_files_of_other_queries_stay(spark, tmp_path):
    path = str(tmp_path / "all")
    schema = "source string, query string, name string"
    first = spark.createDataFrame([("s", "a", "A")], schema)
    write_listings_csv(first, path)
    write_listings_csv(spark.createDataFrame([("s", "b", "B")], schema), path)
    write_listings_csv(first, path)
    write_listings_csv(spark.createDataFrame([], schema), path)
    found = {f.parent.name: f.read_text("utf-8-sig") for f in csv_files(tmp_path / "all")}
    assert found == {"query=a": "name\nA\n", "query=b": "name\nB\n"}


def test_compat_listing_file(spark, tmp_path):
    frame = card_listings(captures(spark, fv.TRIVAGO, html.card_page(html.card("A", "서울", "9", None, "1,000"))))
    write_listings_csv(compat_view(frame, link=False), str(tmp_path / "one"), by=(), skip_empty=False)
    (file,) = csv_files(tmp_path / "one")
    assert file.read_text("utf-8-sig").splitlines() == [
        "숙소명,숙소유형,위치,평점,가격", 'A,유형 정보 없음,서울,9,"1,000원"']


def test_ranking_csv_is_ordered(spark, tmp_path):
    rows = [(s, rank, f"r{rank}") for rank in range(30, 0, -1) for s in (fv.YEOGI, fv.TRIVAGO)]
    write_rankings_csv(spark.createDataFrame(rows, schemas.RANKINGS).repartition(5), str(tmp_path / "r"))
    lines = [line for f in csv_files(tmp_path / "r") for line in f.read_text("utf-8").splitlines()]
    body = [line for line in lines if not line.startswith("\ufeffSource,Rank,Region")]
    assert body == [f"{s},{rank},r{rank}" for s in (fv.TRIVAGO, fv.YEOGI) for rank in range(1, 31)]
    assert lines[0] == "\ufeffSource,Rank,Region"


def test_typed_listings_as_parquet(spark, tmp_path):
    listings = room_listings(captures(spark))
    write_listings(listings, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).select(listings.columns)
    assert back.collect() == listings.collect()


def test_durable_keeps_rows_and_schema(spark):
    frame = spark.createDataFrame([(1, None), (2, [3])], "a int, b array<int>")
    stored = durable(frame)
    assert sorted(stored.collect()) == sorted(frame.collect()) and stored.schema == frame.schema


def test_stored_tables_are_shared_and_can_be_removed(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    assert spark.sparkContext.applicationId in folder.name
    first, second = durable(spark.range(3)), durable(spark.range(4))
    assert len(list(folder.iterdir())) >= 2
    release(first, spark.range(1))
    assert second.count() == 4
    clear_stored(spark)
    assert not folder.exists()


def test_arriving_pages(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for request in ("r1", "r2"):
        captures(spark, request=request).write.mode("append").parquet(source)
        query = write_arrivals(
            stream_rooms(stream_captures(spark, source)), target, str(tmp_path / "check"))
        query.awaitTermination(120)
    found = spark.read.parquet(target)
    batch = room_listings(read_captures(spark, source)).select(found.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, batch.collect()))
    assert found.count() == 2


def test_pages_of_a_request_that_differ_give_one_request(spark):
    address = "https://www.yeogi.com/domestic-accommodations?keyword=%EC%84%9C%EC%9A%B8&checkIn=2025-01-0{}&checkOut=2025-01-09&personal=2&page={}"
    rows = [("r", "yeogi", page, address.format(day, page)) for page, day in ((2, 5), (1, 4), (1, 4))]
    captures = spark.createDataFrame(rows, "request_id string, source string, page_no int, url string")
    found = requests_from_captures(captures).collect()
    assert [(r.request_id, str(r.check_in)) for r in found] == [("r", "2025-01-04")]
