from datetime import datetime

import pytest

from tidemark.operators.timestamps import normalise_times, unplain_times

SCHEMA = "row_id long, core_yr string, core_mo string, core_dy string, core_hr string, c1_dck string, received_at timestamp_ntz, dck string, _t_utc int"
DECKS = [("201", "UTC"), ("721", "Europe/Berlin"), ("780", None), ("999", "No/Where")]
CASES = [
    ("2001", "7", "4", "12.50", "201", None),  # plain
    ("2001", "07", "4", "12.50", "201", "2001-07-04 12:30"),
    ("2001", "7", "4", "24:00", "201", "2001-07-05 00:00"),
    ("2001", "7", "4", "25.10", "201", "unclear"),
    ("2001", "2", "30", "1.00", "201", "unclear"),
    ("2001", None, "60", "1.00", "201", "2001-03-01 01:00"),
    ("2001", "VII", "4th", "9.15 p.m.", "201", "2001-07-04 21:15"),
    ("2001", "Jul", "4.", "12:05am", "201", "2001-07-04 00:05"),
    ("2001", "7", "4", "18h06", "721", "2001-07-04 16:06"),
    ("2001", "7", "4", "0915 CEST", "201", "2001-07-04 07:15"),
    ("2001", "7", "4", "10:00 UTC-3:30", "721", "2001-07-04 13:30"),
    ("2001-07-04T23:30:29.600-05:00", None, None, None, "780", "2001-07-05 04:30"),
    ("20010704", None, None, "2345", "721", "2001-07-04 21:45"),
    (None, None, None, "1544148360.0", "780", "2018-12-07 02:06"),
    (None, None, None, "884063880000", "780", "1998-01-06 05:18"),
    ("2019", "3", "31", "2.50", "721", "unclear"),  # skipped
    ("2018", "10", "28", "2.50", "721", "unclear"),  # shown twice
    ("2018", "10", "28", "3.50", "721", "2018-10-28 02:30"),
    ("2001", "7", "4", "12.50", "780", "unclear"),  # no known zone
    ("2001", "7", "4", "12.50", "999", "unclear"),
    ("2001", "7", "4", "12.50", None, "unclear"),
    (None, None, None, None, "201", "unclear"),
    ("2001", "7", None, "12.50", "201", "unclear"),
    ("x" * 5000, "7", "4", "noon?", "201", "unclear"),
]


@pytest.fixture
def decks(spark):
    return spark.createDataFrame(DECKS, "dck string, time_zone string")


def test_found(spark, decks):
    rows = [(i, *c[:5], datetime(2001, 7, 4, 13), "clash", 1) for i, c in enumerate(CASES)]
    got = {r.row_id: r.utc_time for r in unplain_times(spark.createDataFrame(rows, SCHEMA), decks).collect()}
    assert got == {i: c[5] for i, c in enumerate(CASES) if c[5] is not None}


def test_zone_is_estimated_from_receipt(spark, decks):
    known = [(i, "2001", "7", str(1 + i % 28), f"{i % 20}.00", "201", datetime(2001, 7, 1 + i % 28, i % 20, 20), "", 0) for i in range(200)]
    # readings of an office five hours behind UTC
    unknown = [(1000 + i, "2001", "7", str(1 + i % 28), f"{i % 15}.00", "780", datetime(2001, 7, 1 + i % 28, i % 15 + 5, 20), "", 0) for i in range(200)]
    out = normalise_times(spark.createDataFrame(known + unknown, SCHEMA), decks).filter("row_id >= 1000").collect()
    assert {r._t_status for r in out} == {"estimated"} and {r._t_offset for r in out} == {-300}


def test_empty(spark, decks):
    assert unplain_times(spark.createDataFrame([], SCHEMA), decks).count() == 0
    assert unplain_times(spark.createDataFrame([(1, "2001", "7", "4", "1.00", "201", None, "", 0)], SCHEMA), decks.limit(0)).first().utc_time == "unclear"
