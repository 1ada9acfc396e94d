import numpy as np
import pytest
from conftest import bars, days_array, members
from pyspark.sql import functions as F

from panelwise.operators import asof, ensembles as E, signals as S
from panelwise.operators.returns import benchmark_returns

DAY = "2023-10-20"


def one(spark, b, sig, tickers, bench=None, day=DAY):
    marks = asof.markers(members(spark, *tickers), days_array(day))
    df = S.score(b, marks, [sig], benchmark_returns(b, bench) if bench else None)
    return {r.ticker: r[sig.name] for r in df.collect()}


@pytest.fixture(scope="module")
def panel(spark):
    up = [100 * 1.002**i for i in range(290)]
    down = [100 * 0.999**i for i in range(290)]
    late = [100 * 1.001**i if i < 250 else 100 * 1.001**250 * 1.01 ** (i - 250) for i in range(290)]
    short = [None] * 270 + [100 + i for i in range(20)]
    return bars(spark, {"UP": up, "DOWN": down, "LATE": late, "NEW": short}).cache()


T = ("UP", "DOWN", "LATE", "NEW")


def test_momentum_values_and_short_history(spark, panel):
    s = one(spark, panel, S.momentum(60, 50), T)
    assert s["UP"] == pytest.approx(1.002**59 - 1)
    assert s["DOWN"] == pytest.approx(0.999**59 - 1)
    assert s["NEW"] is None
    assert s["LATE"] > s["UP"] > s["DOWN"]


def test_momentum_ignores_the_future(spark, panel):
    cut = panel.filter(F.col("date") < DAY)
    spiked = cut.unionByName(panel.filter(F.col("date") >= DAY).withColumn("close", F.lit(1e9)))
    assert one(spark, spiked, S.momentum(60, 50), T) == one(spark, cut, S.momentum(60, 50), T)


def test_calendar_window_limits_rows(spark, panel):
    """On weekday bars a 252-row lookback only sees the rows of 302 calendar days."""
    b = bars(spark, {"W": [100 + i for i in range(400)]}, start="2022-01-03", freq="B")
    s = one(spark, b, S.momentum(252, 200), ["W"], day="2023-06-01")
    rows = [r.close for r in asof.read_prices(b, "2023-06-01", 302).orderBy("date").collect()]
    assert len(rows) < 252 and s["W"] == pytest.approx(rows[-1] / rows[0] - 1)


def test_acceleration(spark, panel):
    s = one(spark, panel, S.momentum_acceleration(21, 126, 100), T)
    assert s["LATE"] == pytest.approx((1.01**20 - 1) - (100 * 1.001**250 * 1.01**41 / (100 * 1.001**166) - 1), rel=0.2)
    assert s["DOWN"] == pytest.approx((0.999**20 - 1) - (0.999**125 - 1))


@pytest.mark.parametrize("args", [(63, 63, 100), (63, 126, 50), (10, 126, 100)])
def test_acceleration_parameter_checks(args):
    with pytest.raises(ValueError):
        S.momentum_acceleration(*args)


def test_vol_floor(spark, panel):
    s = one(spark, panel, S.vol_adjusted_momentum(60, 50, 0.01), T)
    assert s["UP"] == pytest.approx((1.002**59 - 1) / 0.01, rel=1e-6)


def test_vol_adjusted_matches_numpy(spark):
    rng = np.random.default_rng(1)
    px = 100 * np.cumprod(1 + rng.normal(0, 0.02, 200))
    b = bars(spark, {"R": list(px)}, start="2023-04-01")
    s = one(spark, b, S.vol_adjusted_momentum(100, 50, 0.01), ["R"], day="2023-10-10")
    w = px[: (np.datetime64("2023-10-10") - np.datetime64("2023-04-01")).astype(int)][-100:]
    r = w[1:] / w[:-1] - 1
    assert s["R"] == pytest.approx((w[-1] / w[0] - 1) / (r.std(ddof=1) * np.sqrt(252)))


def test_residual_beta_only_is_zero_and_alpha_is_positive(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(0.0005, 0.01, 220)
    series = {"SPY": m, "BETA": 1.3 * m, "ALPHA": 0.8 * m + 0.001}
    b = bars(spark, {k: list(100 * np.cumprod(1 + v)) for k, v in series.items()}, start="2023-03-01")
    s = one(spark, b, S.residual_momentum(126, 100, "SPY"), ["SPY", "BETA", "ALPHA"], "SPY", "2023-10-01")
    assert s["SPY"] is None
    assert s["BETA"] == pytest.approx(0, abs=1e-9)
    assert s["ALPHA"] == pytest.approx(0.001 * 175, rel=1e-6)


def test_trend_filter(spark, panel):
    marks = asof.markers(members(spark, *T), days_array("2023-01-20", DAY))
    flags = {str(r.as_of): r.bullish for r in S.trend_flag(panel, marks, "DOWN", 100).collect()}
    assert flags == {"2023-01-20": True, DAY: False}
    wide = S.score(panel, marks, [S.momentum(60, 50, "m")])
    out = S.trend_filtered(wide, S.trend_flag(panel, marks, "DOWN", 100), "m", ["UP"]).filter(F.col("as_of") == DAY)
    assert {r.ticker: r.m for r in out.collect()} == {"UP": 1.0, "DOWN": 0.0, "LATE": 0.0, "NEW": 0.0}


def test_dual_momentum(spark, panel):
    marks = asof.markers(members(spark, *T), days_array(DAY))
    wide = S.score(panel, marks, [S.momentum(60, 50, "m")])
    on = {r.ticker: (r.m, r.signal_type) for r in S.dual_momentum(wide, "m", 60, 0.02, ["DOWN"]).collect()}
    assert on["UP"][0] > 0 and on["DOWN"] == (0.0, "MOMENTUM") and on["NEW"][0] == 0.0
    off = {r.ticker: (r.m, r.signal_type) for r in S.dual_momentum(wide, "m", 60, 99.0, ["DOWN"]).collect()}
    assert off == {"UP": (0.0, "SAFE"), "DOWN": (1.0, "SAFE"), "LATE": (0.0, "SAFE"), "NEW": (0.0, "SAFE")}


def test_value_momentum_cancels_at_equal_weights(spark, panel):
    marks = asof.markers(members(spark, *T), days_array(DAY))
    wide = S.score(panel, marks, [S.momentum(60, 50, "m"), S.momentum(60, 50, "v")])
    got = S.value_momentum(wide, "m", "v").collect()
    assert all(r.blended is None if r.ticker == "NEW" else abs(r.blended) < 1e-9 for r in got)
    z = [r.momentum_z for r in got if r.momentum_z is not None]
    assert sum(z) == pytest.approx(0) and np.std(z, ddof=1) == pytest.approx(1)


def test_zscore_without_spread_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None)], "as_of string, x double")
    got = S.zscore(df.withColumn("as_of", F.lit("d")), "x", "z").collect()
    assert sorted((r.x is None, r.z) for r in got) == [(False, 0.0), (False, 0.0), (True, None)]


def test_ensemble_and_selection(spark):
    sc = spark.createDataFrame(
        [("m1", "d1", "A", 1.0), ("m2", "d1", "A", 3.0), ("m1", "d1", "B", None), ("m2", "d1", "B", 2.0), ("m1", "d1", "C", None), ("m2", "d1", "C", None)],
        "model string, as_of string, ticker string, score double")
    got = {r.ticker: r.score for r in E.weighted_ensemble(sc, {"m1": 0.5, "m2": 0.25}).collect()}
    assert got == {"A": 1.25, "B": 0.5, "C": None}
    reg = spark.createDataFrame([("d1", "X")], "as_of string, regime string")
    two = E.select_models(reg, E.selection_table(spark, {"Y": {"m1": 1.0}}, {"m1": 1.0, "m2": 3.0}))
    got = {r.ticker: r.score for r in E.apply_selection(sc, two).collect()}
    assert got == {"A": 2.5, "B": 1.5, "C": 0.0}
    solo = E.select_models(reg, E.selection_table(spark, {"X": {"m1": 2.0}}, {"m2": 1.0}))
    got = {r.ticker: r.score for r in E.apply_selection(sc, solo).collect()}
    assert got == {"A": 1.0, "B": None, "C": None}
    for bad in ({"m1": -1.0}, {"m1": 0.0}):
        with pytest.raises(ValueError):
            E.selection_table(spark, {"X": bad}, {"m1": 1.0})


def test_lookback_in_rows_ignores_the_calendar(spark):
    b = bars(spark, {"A": list(range(100, 160))}, freq="7D")
    marks = asof.markers(members(spark, "A"), days_array("2025-01-01"))
    calendar, rows = S.momentum(20, 20), S.in_rows(S.momentum(20, 20, name="rows"))
    r = S.score(b, marks, [calendar, rows, S.in_rows(S.vol_adjusted_momentum(20, 20, name="vol"))]).first()
    assert r.momentum is None and r.rows == pytest.approx(159 / 140 - 1) and r.vol is not None
    with pytest.raises(ValueError):
        S.in_rows(S.residual_momentum())
