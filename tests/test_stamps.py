import datetime as dt
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.operators import zones
from logweave.operators.stamps import LAYOUTS, epoch_to_ms, instants, layouts_of, to_epoch_ms


def ms(*texts, zone="Europe/Madrid", year=2024, date="2024-10-27", day_first=True):
    n = len(texts)
    got = instants(pd.Series(texts, dtype=object), pd.Series([zone] * n), pd.Series([year] * n), pd.Series([date] * n), pd.Series([day_first] * n, dtype=object))
    return [None if x is pd.NA else int(x) for x in got]


def at(text):
    return int(dt.datetime.fromisoformat(text).timestamp() * 1000)


@pytest.mark.parametrize("text, want", [
    ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05+00:00"), ("2024-01-02 03:04:05", "2024-01-02T03:04:05+01:00"), ("02/01/2024 3:04:05 PM", "2024-01-02T15:04:05+01:00"),
    ("02.01.2024", "2024-01-02T00:00:00+01:00"), ("27/Oct/2024:02:53:59 +0530", "2024-10-27T02:53:59+05:30"), ("Sat Mar 30 02:03:04 2024", "2024-03-30T02:03:04+01:00"),
    ("Sun Mar 31 01:02:07 CET 2024", "2024-03-31T01:02:07+01:00"), ("Oct  7 01:02:03", "2024-10-07T01:02:03+02:00"), ("29 de março de 2025 08:49:54", "2025-03-29T08:49:54+01:00"),
    ("16. Oktober 2025 07:14:30", "2025-10-16T07:14:30+02:00"), ("20251023T160636Z", "2025-10-23T16:06:36+00:00"), ("1028 18:02:07.940000", "2024-10-28T18:02:07.940+01:00"),
    ("2024-09-13T04:03:57+09:00[Europe/Berlin]", "2024-09-13T04:03:57+09:00"), ("2024-09-13T04:03:57[America/New_York]", "2024-09-13T04:03:57-04:00"), ("03:59:40,894", "2024-10-27T03:59:40.894+01:00"),
    ("2024-10-29 16:44:10 +0000 UTC", "2024-10-29T16:44:10+00:00"), ("1711968961.257", "2024-04-01T10:56:01.257+00:00"), ("1729860851022987654", "2024-10-25T12:54:11.022+00:00"),
])
def test_layouts(text, want):
    assert ms(text) == [at(want)]


def test_repeated_and_skipped_wall_times():
    assert ms("2024-10-27 02:30:00") == [at("2024-10-27T02:30:00+02:00")]  # twice: the earlier instant
    assert ms("2024-03-31 02:30:00") == [at("2024-03-31T03:30:00+02:00")]  # skipped: moved on
    assert ms("2025-10-05 02:15:00", zone="Australia/Sydney") == [at("2025-10-05T03:15:00+11:00")]


def test_no_real_time():
    assert ms("30/02/2024 10:00:00", "2024-13-01", "25:61:00", "n/d", "-", "", None, "0000-00-00 00:00:00", "13:00:00 PM", "99", "x 9 y") == [None] * 11
    assert ms("13/14/2024") == [None] and ms("02/13/2024", day_first=False) == [at("2024-02-13T00:00:00+01:00")]
    assert ms("2024-01-01 00:00:00", zone="No/Where") == [None]


def test_nulls_of_the_origin():
    got = instants(pd.Series(["2024-01-02 00:00:00", "Oct 7 01:02:03", "01:02:03"]), pd.Series([None] * 3), pd.Series([None] * 3), pd.Series([None] * 3), pd.Series([None] * 3))
    assert got[0] == at("2024-01-02T00:00:00+00:00") and got[1] is pd.NA and got[2] is pd.NA


@settings(max_examples=150, deadline=None)
@given(st.datetimes(dt.datetime(1975, 1, 1), dt.datetime(2090, 1, 1)), st.sampled_from(["Europe/Lisbon", "America/Sao_Paulo", "Asia/Kolkata", "Australia/Sydney", "America/Chicago", "UTC"]))
def test_against_the_standard_library(wall, zone):
    wall = wall.replace(microsecond=wall.microsecond // 1000 * 1000)
    text = wall.strftime("%Y-%m-%d %H:%M:%S.") + f"{wall.microsecond // 1000:03d}"
    want = wall.replace(tzinfo=ZoneInfo(zone), fold=0).timestamp()
    assert ms(text, zone=zone) == [round(want * 1000)]


def test_tables_are_versioned():
    version, packed = zones.edition()
    z = zones.Zones(packed)
    assert version and z.get("No/Where") is None and z.get("../UTC") is None and len(z.get("UTC").walls) <= 2


@settings(max_examples=300, deadline=None)
@given(st.datetimes(dt.datetime(1850, 1, 1), dt.datetime(2700, 1, 1)).map(lambda x: x.replace(microsecond=0)), st.sampled_from(["Europe/Berlin", "America/Sao_Paulo", "Asia/Kolkata", "Australia/Lord_Howe", "Europe/Dublin", "Africa/Casablanca", "America/Santiago", "Pacific/Apia"]))
def test_instants_of_any_year(wall, zone):
    assert ms(wall.strftime("%Y-%m-%d %H:%M:%S"), zone=zone) == [round(wall.replace(tzinfo=ZoneInfo(zone), fold=0).timestamp() * 1000)]


@pytest.mark.parametrize("zone, text", [("America/Sao_Paulo", "1932-01-15 12:00:00"), ("Europe/Berlin", "1945-06-15 12:00:00"), ("Europe/Berlin", "2105-07-01 12:00:00"), ("Europe/Lisbon", "1900-01-01 00:00:00"), ("America/New_York", "2150-07-04 00:00:00")])
def test_beyond_the_usual_years(zone, text):
    assert ms(text, zone=zone) == [round(dt.datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone)).timestamp() * 1000)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.from_regex(r"(?:\d{1,2}[-/. ]){1,2}(?:\d{4}|[A-Za-z]{1,4})[ T,]{0,2}\d{1,2}:\d\d(?::\d\d)?(?: ?[AP]M)?(?:Z| UTC|\+01:00)?", fullmatch=True), min_size=1, max_size=5))
def test_masks_hold_all_layouts_of_their_texts(texts):
    """The layouts of a mask are those of any of its texts, whichever comes first."""
    import regex

    for t in texts:
        mask = regex.sub(r"\p{L}+", "a", regex.sub(r"\d", "9", t.strip()))
        assert {k for k, p in enumerate(LAYOUTS) if regex.fullmatch(p, t.strip())} <= set(layouts_of(mask))
    assert ms(*texts) == [ms(t)[0] for t in texts]


def test_columns(spark):
    df = spark.createDataFrame([("2024-01-02 00:00:00", "UTC", 2024, None, True), (None, None, None, None, None)], "t string, z string, y int, d string, f boolean")
    assert [r[0] for r in df.select(to_epoch_ms("t", "z", "y", "d", "f")).collect()] == [1704153600000, None]
    assert df.limit(0).select(to_epoch_ms("t", "z", "y", "d", "f")).count() == 0
    assert df.withColumn("x", to_epoch_ms("t", "z", "y", "d", "f")).schema["x"].metadata["zone_version"] == zones.edition()[0]
    e = spark.createDataFrame([(0,), (None,), (1735693000,), (1735693000123,), (1735693000123999,), (1735693000123999999,), (-5,)], "v long")
    assert [r[0] for r in e.select(epoch_to_ms(F.col("v"))).collect()] == [None, None, 1735693000000, 1735693000123, 1735693000123, 1735693000123, -5000]
