from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import spikes, unit_resolution

OBS = "row_id long, observation_id string, report_id string, date_time timestamp_ntz, observed_variable int, observation_value double, units int, units_text string, imodel string, element string, sensor_id string, valid_min string"
ELEMENTS = "imodel string, section string, element string, units string, valid_min double, valid_max double"


@pytest.fixture
def elements(spark):
    rows = [("m", "s", "AT", "Deg. C", -70.0, 70.0), ("m", "s", "P", "0,1 hPa", 8500.0, 11000.0), ("m", "s", "W", None, 0.0, 99.0), ("m", "s", "X", "bananas", None, None)]
    return spark.createDataFrame(rows, ELEMENTS)


def row(i, variable, value, code=None, text=None, element="AT", report="R", sensor="S", at=0):
    return (i, f"o{i}", report, datetime(2000, 1, 1) + timedelta(hours=at), variable, value, code, text, "m", element, sensor, "clash")


def test_units(spark, elements):
    rows = [
        row(1, 85, 280.0, 5), row(2, 85, 10.0, 60), row(3, 85, 100.0, None, "degC x 10"), row(4, 85, 50.0, None, "degrees fahr."), row(5, 85, 10.0), row(6, 58, 10131.0, element="P"),
        row(7, 58, 29.9, None, "in Hg (corrected)"), row(8, 107, 10.0, None, "statute miles an hour"), row(9, 106, 10.0, 320), row(10, 85, None, 60), row(11, 58, 1013.0, 5, "mb", "P"), row(12, None, 1.0, 5),
        row(13, 107, 3.0, None, "m s-1"), row(14, 95, 283.0, None, "?", "none"), row(15, 85, 283.4, None, "Kelvin"), row(16, 58, 760.0, None, "Torr"),
    ]
    out = {r.row_id: r for r in unit_resolution.resolve_units(spark.createDataFrame(rows, OBS), elements).collect()}
    assert len(out) == 16
    assert {i: out[i]._u_unit for i in out} == {1: "K", 2: "degC", 3: "0.1degC", 4: "degF", 5: "degC", 6: "0.1hPa", 7: "inHg", 8: "mph", 9: None, 10: None, 11: "hPa", 12: None, 13: "m/s", 14: "K", 15: "K", 16: "mmHg"}
    assert out[3]._u_value == 283.15 and out[6]._u_value == 101310.0 and out[5]._u_max == 343.15
    assert out[14]._u_basis in ("solved", "not unique")
    found = {r.row_id for r in unit_resolution.found(spark.createDataFrame(rows, OBS), elements).collect()}
    assert found == {2, 3, 4, 5, 6, 7, 8, 11, 16}
    assert unit_resolution.found(spark.createDataFrame([], OBS), elements).count() == 0


def brute(v, outside):
    n, kinds = len(v), {}
    m = np.median(np.abs(np.diff(v)).round(6))
    for i in range(n):
        a = i
        while a > 0 and v[a - 1] == v[i]:
            a -= 1
        b = i
        while b + 1 < n and v[b + 1] == v[i]:
            b += 1
        if outside[i]:
            kinds[i] = "impossible"
        elif b - a + 1 >= 10:
            kinds[i] = "stuck"
        elif 0 < i < n - 1 and (v[i] - v[i - 1]) * (v[i] - v[i + 1]) > 0 and round(min(abs(v[i] - v[i - 1]), abs(v[i] - v[i + 1])), 6) > round(10 * m, 6):
            kinds[i] = "spike"
    return kinds


@pytest.mark.parametrize("parts", [None, 60])
def test_spikes_against_brute_force(spark, elements, parts):
    rng = np.random.default_rng(5)
    v = np.round(280 + np.cumsum(rng.normal(0, 0.2, 600)), 1)
    v[[50, 300, 301, 420]] += [15, 20, -20, 25]
    v[200:212] = v[200]
    v[100] = 400.0
    rows = [row(i, 85, float(x), 5, at=i) for i, x in enumerate(v)]
    copies = [(1000 + r[0], *r[1:]) for r in rows[::7]]
    short = [row(5000 + i, 85, 280.0 + 50 * (i == 3), 5, at=i, sensor="T") for i in range(20)]
    nobody = [row(6000 + i, 85, 999.0, 5, at=i, sensor=None) for i in range(30)]
    df = spark.createDataFrame(rows + copies + short + nobody, OBS)
    got = {r.row_id: r.kind for r in spikes.flagged(df, elements, parts).collect()}
    assert got == brute(v, (v < 203.15) | (v > 343.15))
    assert spikes.flagged(df.limit(0), elements).count() == 0


def test_pieces_of_gaps_do_not_part_neighbours(spark, elements):
    """A long outage of null values, with a run of equal readings across it and a spike at its end."""
    rng = np.random.default_rng(6)
    v = np.round(280 + np.cumsum(rng.normal(0, 0.05, 5000)), 1)
    v[2495:2505] = v[2495]
    w = np.round(280 + np.cumsum(rng.normal(0, 0.05, 5000)), 1)
    w[2500] += 25
    gap = 3000
    rows = [row(i, 85, float(x), 5, at=i + gap * (i >= 2500)) for i, x in enumerate(v)]
    rows += [row(20_000 + i, 85, float(x), 5, at=i + gap * (i > 2500), sensor="T") for i, x in enumerate(w)]
    nulls = [row(start + i, 85, None if i % 2 else float("nan"), 5, at=at + i, sensor=s) for s, start, at in (("S", 40_000, 2500), ("T", 50_000, 2501)) for i in range(gap)]
    got = {r.row_id: r.kind for r in spikes.flagged(spark.createDataFrame(rows + nulls, OBS), elements, 200).collect()}
    none = np.zeros(5000, dtype=bool)
    assert got == brute(v, none) | {20_000 + i: k for i, k in brute(w, none).items()}


def test_a_series_of_mostly_null_values(spark, elements):
    """Every fiftieth row has a value, twelve of them equal in succession; parts hold fewer readings than a run."""
    v = [280.0 + i % 7 for i in range(200)]
    v[60:72] = [281.5] * 12
    rows = [row(i, 85, v[i // 50] if i % 50 == 0 else None, 5, at=i) for i in range(10_000)]
    df = spark.createDataFrame(rows, OBS)
    for parts in (None, 50, 190):
        assert sorted(r.row_id for r in spikes.flagged(df, elements, parts).filter("kind = 'stuck'").collect()) == [i * 50 for i in range(60, 72)]


def test_series_without_observation_ids(spark, elements):
    rows = [(i, None, *row(i, 85, 280.0 + i % 7 + 90 * (i == 70), 5, at=i)[2:]) for i in range(500)]
    assert [tuple(r) for r in spikes.flagged(spark.createDataFrame(rows, OBS), elements, 9).collect()] == [(70, "impossible")]


def test_outliers_of_trend_and_season(spark, elements):
    """A daily wave of twelve degrees: a reading that fits another hour is an outlier of its season, not of its neighbours' size."""
    rng = np.random.default_rng(8)
    wave = lambda i: 280 + 6 * np.sin(i / 24 * 2 * np.pi)
    v = np.array([wave(i) + rng.normal(0, 0.05) for i in range(24 * 40)])
    v[400] += 1.5
    rows = [row(i, 85, float(np.round(x, 2)), 5, at=i) for i, x in enumerate(v)]
    out = {r.row_id: r for r in spikes.outliers(spark.createDataFrame(rows, OBS), elements, 5).collect()}
    inner = [i for i in out if 4 <= i < 24 * 40 - 4]  # at either end the window of the trend is cut
    assert out[400].slow and len(inner) <= 8


def test_critical_values_of_esd(spark):
    from pyspark.sql import functions as F

    # Rosner's example: 54 readings, alpha 0.05
    got = spark.range(1).select(spikes.esd_critical(F.lit(54.0)).alias("x")).first().x
    assert abs(got - 3.158) < 0.01
