import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import regimes as R


def labels(spark, rows, **kw):
    data = [(dt.date(2023, 1, 1) + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "date date, price double, ma double, vix double")
    return [(r.trend, r.vol) for r in R.hysteresis_labels(df, **kw).orderBy("date").collect()]


@pytest.mark.parametrize("row,want", [
    ((103, 100, 15), ("uptrend", "low_vol")), ((97, 100, 30), ("downtrend", "high_vol")), ((101, 100, 22), ("uptrend", "low_vol")),
    ((99, 100, 22), ("downtrend", "low_vol")), ((100, 100, 25), ("uptrend", "low_vol")), ((102, 100, 20), ("uptrend", "low_vol")),
])
def test_first_row(spark, row, want):
    assert labels(spark, [row]) == [want]


def test_band_keeps_previous_state(spark):
    got = labels(spark, [(105, 100, 30), (99, 100, 22), (97.9, 100, 22), (101.9, 100, 19.9), (102.1, 100, 25), (98, 100, 25.1)])
    assert got == [("uptrend", "high_vol"), ("uptrend", "high_vol"), ("downtrend", "high_vol"), ("downtrend", "low_vol"), ("uptrend", "low_vol"), ("uptrend", "high_vol")]


def test_labels_equal_sequential_rule(spark):
    rng = np.random.default_rng(8)
    rows = [(100 + rng.normal(0, 2.5), 100.0, 22 + rng.normal(0, 4)) for _ in range(200)]
    trend = vol = None
    want = []
    for p, m, v in rows:
        trend = "downtrend" if p < m * .98 else "uptrend" if p > m * 1.02 else trend or ("uptrend" if p >= m else "downtrend")
        vol = "high_vol" if v > 25 else "low_vol" if v < 20 else vol or "low_vol"
        want.append((trend, vol))
    assert labels(spark, rows) == want


@pytest.mark.parametrize("vix,spread,alpha,monitor,accessor", [
    (15.0, 1.0, "RISK_ON", "RISK_ON", "RISK_ON"), (25.0, 1.0, "ELEVATED_VOL", "ELEVATED_VOL", "ELEVATED_VOL"), (35.0, 1.0, "HIGH_VOL", "HIGH_VOL", "HIGH_VOL"),
    (35.0, -0.3, "RECESSION_WARNING", "RECESSION_WARNING", "HIGH_VOL"), (35.0, -0.6, "RECESSION_WARNING", "RECESSION_WARNING", "RECESSION_WARNING"),
    (15.0, -0.1, "RECESSION_WARNING", "RECESSION_WARNING", "ELEVATED_VOL"), (None, 1.0, "UNKNOWN", "UNKNOWN", "UNKNOWN"), (None, -1.0, "UNKNOWN", "RECESSION_WARNING", "UNKNOWN"),
    (15.0, None, "UNKNOWN", "RISK_ON", "UNKNOWN"), (30.0, 0.0, "ELEVATED_VOL", "ELEVATED_VOL", "ELEVATED_VOL"), (20.0, 0.0, "RISK_ON", "RISK_ON", "RISK_ON"),
])
def test_macro_variants(spark, vix, spread, alpha, monitor, accessor):
    df = spark.createDataFrame([(vix, spread)], "v double, s double")
    got = df.select(*[R.macro_regime("v", "s", x).alias(x) for x in ("alpha", "monitor", "accessor")]).first()
    assert tuple(got) == (alpha, monitor, accessor)


@pytest.mark.parametrize("old,new,level", [
    ("RISK_ON", "HIGH_VOL", "CRITICAL"), ("ELEVATED_VOL", "RECESSION_WARNING", "CRITICAL"), ("RISK_ON", "ELEVATED_VOL", "WARNING"),
    ("HIGH_VOL", "RISK_ON", "INFO"), ("RECESSION_WARNING", "HIGH_VOL", "INFO"), ("UNKNOWN", "RISK_ON", "INFO"),
])
def test_alert_levels(spark, old, new, level):
    d = dt.date(2023, 1, 1)
    df = spark.createDataFrame([(d, old), (d + dt.timedelta(1), old), (d + dt.timedelta(2), new)], "date date, regime string")
    rows = R.regime_alerts(df).collect()
    assert [(r.date, r.level) for r in rows] == [(d + dt.timedelta(2), level)]


def test_moving_average_needs_full_window(spark):
    d = [dt.date(2023, 1, 1) + dt.timedelta(i) for i in range(6)]
    b = spark.createDataFrame([(x, float(i)) for i, x in enumerate(d)], "date date, price double")
    v = spark.createDataFrame([(d[0], 20.0), (d[3], 30.0)], "date date, value double")
    rows = R.trend_indicators(b, v, 4).orderBy("date").collect()
    assert [r.ma for r in rows] == [None, None, None, 1.5, 2.5, 3.5]
    assert [r.vix for r in rows] == [20.0, 20.0, 20.0, 30.0, 30.0, 30.0]


def test_strategy_map_fallback(spark):
    df = spark.createDataFrame([("a",), ("zz",), (None,)], "regime string")
    got = {r.regime: r.strategy for r in R.map_strategy(df, {"a": "m1"}, "m0").collect()}
    assert got == {"a": "m1", "zz": "m0", None: "m0"}


def test_macro_aliases():
    assert R.series_id("TREASURY_SPREAD_10Y2Y") == R.series_id("YIELD_CURVE_10Y2Y") == "T10Y2Y" and R.series_id("DGS10") == "DGS10"
