from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notarium.functions import dates
from notarium.operators import timestamps as ts


def us(*args, tz=UTC):
    return round((datetime(*args, tzinfo=tz) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def read(spark, rows):
    df = spark.createDataFrame([(i, r, z) for i, (r, z) in enumerate(rows)], "k int, raw string, zone string")
    return [r.utc_us for r in ts.with_instant(df, "raw", "zone").orderBy("k").collect()]


CASES = [
    (("1694843133", None), us(2023, 9, 16, 5, 45, 33)),
    (("1697769843000", "Asia/Tokyo"), us(2023, 10, 20, 2, 44, 3)),
    (("1678630528424592", None), 1678630528424592),
    (("1676138508561712375", None), 1676138508561712),
    (("-1", None), -1_000_000),
    (("-1000000000000000001", None), -1000000000000001),
    (("1683919669.604", None), 1683919669604000),
    (("2023-02-01T04:46:44.000000390Z", "Asia/Tokyo"), us(2023, 2, 1, 4, 46, 44)),
    (("2023-03-24T18:02:32+1100", None), us(2023, 3, 24, 7, 2, 32)),
    (("2023-10-19T06:14:25-07", None), us(2023, 10, 19, 13, 14, 25)),
    (("2023-05-31T01:24:40+05:45[Asia/Kathmandu]", None), us(2023, 5, 30, 19, 39, 40)),
    (("2024-05-13 22:08:42,152", "UTC"), us(2024, 5, 13, 22, 8, 42, 152000)),
    (("2024-10-31 15:31:25 EDT", "UTC"), us(2024, 10, 31, 19, 31, 25)),
    (("20240119T185726", "Europe/Berlin"), us(2024, 1, 19, 17, 57, 26)),
    (("20240119T095054Z", "Europe/Berlin"), us(2024, 1, 19, 9, 50, 54)),
    (("02.11.2023", "+05:30"), us(2023, 11, 1, 18, 30)),
    (("01.02.2023 22:17:24", None), us(2023, 2, 1, 22, 17, 24)),
    (("02/11/2023 10:04 AM", None), us(2023, 2, 11, 10, 4)),
    (("02/11/2023 12:04 AM", None), us(2023, 2, 11, 0, 4)),
    (("02/11/2023 12:04 PM\t", None), us(2023, 2, 11, 12, 4)),
    (("2023/06/25 13:23", None), us(2023, 6, 25, 13, 23)),
    (("Oct 2, 2024 11:28 PM", None), us(2024, 10, 2, 23, 28)),
    (("Fri, 03 Jan 2025 05:58:36 -0500", None), us(2025, 1, 3, 10, 58, 36)),
    (("2024-02-29", "Nowhere/Nothing"), us(2024, 2, 29)),
    (("2023-10-29 02:30:00", "Europe/Berlin"), us(2023, 10, 29, 0, 30)),  # shown twice: the earlier
    (("2023-03-26 02:30:00", "Europe/Berlin"), us(2023, 3, 26, 1, 30)),  # skipped: the offset before
    (("2025-11-02 01:29:57", "America/New_York"), us(2025, 11, 2, 5, 29, 57)),
]
NONE = ["", " ", "soon", "2026-02-30", "31.11.2025", "0000-00-00", "2025-13-04", "25:61", "2025-06-31T10:00:00Z", "2023-01-01 24:00:00", "2023-01-01 10:60", "13/01/2023 1:00 PM", "02/11/2023 13:04 AM", "2023-02-29", "1900-02-29", "9" * 30, "x" * 100_000, None]


def test_notations(spark):
    assert read(spark, [c for c, _ in CASES]) == [u for _, u in CASES]


def test_what_is_no_time_gives_null(spark):
    assert read(spark, [(v, "Europe/Berlin") for v in NONE]) == [None] * len(NONE)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.datetimes(datetime(1900, 1, 1), datetime(2100, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Sydney", "UTC"])), min_size=40, max_size=80))
def test_local_times_against_zoneinfo(spark, rows):
    got = read(spark, [(f"{d:%Y-%m-%d %H:%M:%S}.{d.microsecond:06}".replace(f"{d:%Y}", f"{d.year:04}", 1), z) for d, z in rows])
    # fold 0 is the earlier of two, and the offset before a skip
    assert got == [us(d.year, d.month, d.day, d.hour, d.minute, d.second, d.microsecond, tz=ZoneInfo(z)) for d, z in rows]


def test_tables_with_gaps(spark):
    notes = spark.createDataFrame([(1, {"date": ["2024-01-01", None], "tz": [" ", "Asia/Tokyo"], "created": None}), (1, {"date": ["2024-01-01", None], "tz": [" ", "Asia/Tokyo"], "created": None}), (2, None), (None, {})], "note_id bigint, meta map<string,array<string>>")
    crawl = spark.createDataFrame([(7, None, "UTC"), (8, "1694843133", None), (8, "1694843133", None)], "crawl_id bigint, mtime_raw string, host_zone string")
    got = {tuple(r) for r in ts.normalised(notes, crawl).where("utc_us is not null").select("src", "row_id", "utc_us").collect()}
    assert got == {("meta", 1, us(2023, 12, 31, 15)), ("crawl", 8, us(2023, 9, 16, 5, 45, 33))}
    assert ts.normalised(notes.limit(0), crawl.limit(0)).count() == 0


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([("2024-01-01", "UTC", 5, "p")], "raw string, zone string, y int, parts string")
    got = ts.with_instant(df, "raw", "zone", out="y")
    assert got.columns == ["raw", "zone", "parts", "y"] and got.first().y == us(2024, 1, 1)


def test_since():
    now = datetime(2026, 3, 31, 12, tzinfo=UTC)
    assert dates.parse_since("", now) is None
    assert dates.parse_since("2026-01-15", now) == datetime(2026, 1, 15, tzinfo=UTC)
    assert dates.parse_since("7d", now) == datetime(2026, 3, 24, 12, tzinfo=UTC)
    assert dates.parse_since("2w", now) == datetime(2026, 3, 17, 12, tzinfo=UTC)
    assert dates.parse_since("1m", now) == datetime(2026, 3, 3, 12, tzinfo=UTC)
    assert dates.parse_since("-7d", now) == datetime(2026, 4, 7, 12, tzinfo=UTC)
    for bad in ("d", "yesterday", "5y"):
        with pytest.raises(ValueError):
            dates.parse_since(bad, now)
