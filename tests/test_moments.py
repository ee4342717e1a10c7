import datetime as dt
import zoneinfo

import pytest

from tidewell.functions.moments import instant_text, source_rules, with_moments

DATES = [
    ("2026-03-20", "DMY", "2026-03-20"), (" 2026-3-2 ", "DMY", "2026-03-02"), ("20/03/2026", "DMY", "2026-03-20"), ("03/20/2026", "MDY", "2026-03-20"), ("20/03/2026", "MDY", None),
    ("05/06/25", "DMY", "2025-06-05"), ("20260320", "DMY", "2026-03-20"), ("45988", "DMY", "2025-11-27"), ("0", "DMY", None), ("March 5, 2026", "MDY", "2026-03-05"), ("5 Sept 2025", "DMY", "2025-09-05"),
    ("Ngày 5 tháng 2 năm 2026", "DMY", "2026-02-05"), ("18 tháng 6, 2026", "DMY", "2026-06-18"), ("2024-12-14T00:00:00+07:00", "DMY", "2024-12-14"), ("2025-02-29", "DMY", None), ("2024-02-29", "DMY", "2024-02-29"),
    ("2026-00-12", "DMY", None), ("0000-00-00", "DMY", None), ("N/A", "DMY", None), ("", "DMY", None), (None, "DMY", None), ("1900-02-29", "DMY", None), ("2000.02.29", "DMY", "2000-02-29"), ("12:30", "DMY", None), ("x" * 5000, "DMY", None),
]

INSTANTS = [
    ("2024-03-06T04:14:10", "Asia/Ho_Chi_Minh", "2024-03-05T21:14:10.000000Z"), ("2024-03-06T04:50:10+07:00", "UTC", "2024-03-05T21:50:10.000000Z"), ("2024-03-04 23:01:35 -0530", "UTC", "2024-03-05T04:31:35.000000Z"),
    ("1709620881", "Asia/Kolkata", "2024-03-05T06:41:21.000000Z"), ("1709485366548", "UTC", "2024-03-03T17:02:46.548000Z"), ("20240302T044721Z", "UTC", "2024-03-02T04:47:21.000000Z"), ("20240305114853", "UTC", "2024-03-05T11:48:53.000000Z"),
    ("Thu, 28 Mar 2024 04:16:54 +1100", "UTC", "2024-03-27T17:16:54.000000Z"), ("02/03/2024 12:05 AM", "UTC", "2024-03-02T00:05:00.000000Z"), ("02/03/2024 12:05 PM", "UTC", "2024-03-02T12:05:00.000000Z"), ("13/03/2024 13:05 PM", "UTC", None),
    ("11:16 ngày 02/03/2024", "Asia/Ho_Chi_Minh", "2024-03-02T04:16:00.000000Z"), ("2024-03-02T10:00:00[Asia/Ho_Chi_Minh]", "UTC", "2024-03-02T03:00:00.000000Z"), ("2024-03-02T10:00:00[Mars/Base]", "UTC", None),
    ("2024-11-03 01:30:00", "America/New_York", "2024-11-03T05:30:00.000000Z"), ("2024-11-03 01:30:00 EST", "America/New_York", "2024-11-03T06:30:00.000000Z"), ("2024-03-10 02:30:00", "America/New_York", "2024-03-10T07:30:00.000000Z"),
    ("2024-03-06T25:10:00", "UTC", None), ("2024-03-06T08:75:00", "UTC", None), ("08:00", "UTC", None), ("2024-03-06", "Australia/Sydney", "2024-03-05T13:00:00.000000Z"), ("2024-03-06T01:02:03.123456789Z", "UTC", "2024-03-06T01:02:03.123456Z"),
    ("2024-03-06T01:02:03", None, "2024-03-06T01:02:03.000000Z"), ("1965-01-01T00:00:00Z", "UTC", "1965-01-01T00:00:00.000000Z"),
]


def test_dates(spark):
    rows = spark.createDataFrame([(i, t, o) for i, (t, o, _) in enumerate(DATES)], "i int, t string, o string")
    got = {r.i: r.d_date for r in with_moments(rows, {"d": "t"}, order="o").collect()}
    assert [(DATES[i][0], got[i]) for i in got] == [(DATES[i][0], DATES[i][2]) for i in got]


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_instants_in_any_session_zone(spark, session_zone):
    rows = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(INSTANTS)], "i int, t string, z string")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        out = with_moments(rows, {"d": "t"}, zone="z")
        got = {r.i: r.x for r in out.select("i", instant_text(out.d_micros).alias("x")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(INSTANTS[i][0], got[i]) for i in got] == [(INSTANTS[i][0], INSTANTS[i][2]) for i in got]


def test_local_times_like_the_standard_library(spark):
    zone = zoneinfo.ZoneInfo("Europe/Berlin")
    start = dt.datetime(2024, 1, 1)
    local = [start + dt.timedelta(hours=7 * k, minutes=k) for k in range(1200)]
    rows = spark.createDataFrame([(i, t.strftime("%Y-%m-%d %H:%M:%S"), "Europe/Berlin") for i, t in enumerate(local)], "i int, t string, z string")
    got = {r.i: r.d_micros for r in with_moments(rows, {"d": "t"}, zone="z").collect()}
    for i, t in enumerate(local):
        assert got[i] == int(t.replace(tzinfo=zone, fold=0).timestamp()) * 1_000_000


def test_unknown_zone_and_repeated_source(spark):
    rows = spark.createDataFrame([("a", "No/Where", "DMY"), ("b", "UTC", None), ("b", "UTC", None)], "source_system string, default_tz string, date_order string")
    got = {r.source_system: r.default_tz for r in source_rules(rows).collect()}
    assert got == {"a": None, "b": "UTC"}


def test_clashing_names_and_no_rows(spark):
    rows = spark.createDataFrame([], "t string, d_date int, date string, micros int")
    out = with_moments(rows, {"d": "t"})
    assert out.count() == 0 and {"t", "date", "micros", "d_date", "d_micros"} == set(out.columns)
