import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from zoneinfo import ZoneInfo
from datetime import datetime, timedelta, timezone

import numpy as np

from litquarry.functions.zones import local_to_utc, zone_table
from litquarry.operators.timestamps import normalise_batch, normalise_dates, shape_mask

TABLES = {z: zone_table(z) for z in ("America/New_York", "Europe/London", "Europe/Berlin", "Australia/Sydney")}


def one(text, tz="America/New_York", order="mdy"):
    return normalise_batch(pd.Series([text], dtype=object), pd.Series([tz], dtype=object), pd.Series([order], dtype=object), TABLES)[0]


@pytest.mark.parametrize(("text", "expected"), [
    ("2024", "2024"), ("2024-05", "2024-05"), ("May 2024", "2024-05"), ("SEP. 2023", "2023-09"), ("2024 Sep", "2024-09"), ("09/2024", "2024-09"),
    ("2024-5-3", "2024-05-03"), ("20240503", "2024-05-03"), ("16th August 2025", "2025-08-16"), ("Fri, 25 Nov 2022", "2022-11-25"),
    ("April 11, 2023", "2023-04-11"), ("09-APR-25", "2025-04-09"), ("2022-Sep-27", "2022-09-27"), ("  2024-05-03 ", "2024-05-03"), ("２０２４-05-03", "2024-05-03"),
    ("03/04/2024", "2024-03-04"), ("1659399431", "2022-08-02T00:17:11.000000Z"), ("1755127822123", "2025-08-13T23:30:22.123000Z"),
    ("20241001T040205Z", "2024-10-01T04:02:05.000000Z"), ("2023-04-18 02:20:02.223-0400", "2023-04-18T06:20:02.223000Z"),
    ("2024-03-01 07:09:42 EST", "2024-03-01T12:09:42.000000Z"), ("Nov 9, 2024 10:27 AM EST", "2024-11-09T15:27:00.000000Z"),
    ("11/10/2023 12:05 am", "2023-11-10T05:05:00.000000Z"), ("2024-01-20T01:13[Europe/Berlin]", "2024-01-20T00:13:00.000000Z"),
    ("2024-03-10 02:30:00", "2024-03-10T07:30:00.000000Z"),  # skipped: carried forward by the gap
    ("2024-11-03 01:30:00", "2024-11-03T05:30:00.000000Z"),  # reads twice: the first
    ("2024-02-30", None), ("00/00/2025", None), ("0000-00-00", None), ("13/13/2024", None), ("2024-01-01 25:00:00", None), ("in press", None), ("", None), (None, None),
    ("2024-03-01 07:09:42 XYZ", None), ("x" * 100_000, None), ("Smith 2024-03-01", None),
])
def test_formats(text, expected):
    assert one(text) == expected


def test_order_and_zone_come_from_the_feed():
    assert one("03/04/2024", order="dmy") == "2024-04-03"
    assert one("03/04/2024", order=None) is None
    assert one("2024-07-01 12:00:00", tz="Europe/London") == "2024-07-01T11:00:00.000000Z"
    assert one("2024-07-01 12:00:00", tz=None) is None
    assert one("2024-07-01 12:00:00 BST", tz="Europe/London") == "2024-07-01T11:00:00.000000Z"


def test_mask():
    assert shape_mask("16th August 2025") == "99A A 9999"


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(TABLES)), st.integers(0, 4_000_000_000))
def test_local_times_as_the_standard_library_has_them(zone, second):
    wall = datetime(1970, 1, 1) + timedelta(seconds=second)
    expected = int(wall.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc).timestamp())
    assert local_to_utc(np.array([second]), TABLES[zone])[0] == expected


def test_table(spark):
    feeds = spark.createDataFrame([("Medindex", "America/New_York", "mdy"), ("Litbase", "Europe/London", "dmy")], "source string, tz_name string, day_order string")
    rows = [("2024-02-30", "c2025", " MEDINDEX", "kept"), (None, "２０２３", "Litbase", None), ("n/a", "0000", "Litbase", ""), (None, None, None, None), ("01/02/2024", "2024", "Litbase", "x"), ("01/02/2024", "2024", "Litbase", "x")]
    df = spark.createDataFrame(rows, "pub_date string, pub_year string, source string, tz_name string")
    out = normalise_dates(df, feeds)
    assert out.columns == ["pub_date", "pub_year", "source", "tz_name", "date_norm"]
    assert sorted((r.pub_date or "", r.date_norm or "") for r in out.collect()) == [
        ("", ""), ("", "2023"), ("01/02/2024", "2024-02-01"), ("01/02/2024", "2024-02-01"), ("2024-02-30", "2025"), ("n/a", "")]
    assert normalise_dates(df.limit(0), feeds).count() == 0
    assert normalise_dates(df, feeds.limit(0)).filter("date_norm = '2024'").count() == 2


def test_outer_blanks_do_not_count_as_length():
    assert one(" " * 90 + "2024-01-05" + "\n" * 90) == "2024-01-05" and one("2024-01-05" + " prose" * 40) is None
    assert one("5" + " " * 200 + "May 2024") == "2024-05-05"
