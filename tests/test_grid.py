import datetime as dt

import pytest
from conftest import SF
from pyspark.sql import functions as F

from panelwise.functions.dates import schedule_days, schedule_table
from panelwise.operators import accounting, asof, construction, grid as G, signals as S, walkforward as WF
from panelwise.operators.returns import benchmark_returns
from panelwise.operators.schedule_defaults import END, START
from panelwise.plans import optimizer as O
from panelwise.sources.panel import bars_from_orders, members_from_orders


def test_grid_size(spark):
    assert len(G.param_sets(["weekly"])) == 57 and len(G.param_sets(["monthly"])) == 89
    c = G.config_table(spark, G.param_sets(), ["tier2", "tier3", "tier4"])
    assert c.count() == 1314 and c.select("strategy_id").distinct().count() == 1314 and c.select("config_name").distinct().count() == 1314
    n = {r.schedule: r["sum(n)"] for r in G.config_counts(c).groupBy("schedule").sum("n").collect()}
    assert n == {"weekly": 513, "monthly": 801}


def test_config_name(spark):
    one = [p for p in G.param_sets(["monthly"], ["vol_adjusted_momentum"])][:1]
    names = {r.config_name for r in G.config_table(spark, one, ["tier2"], [5]).collect()}
    assert names == {"vol_adjusted_momentum_lookback_days63_min_periods50_vol_floor0.005_top5_tier2_monthly"}


@pytest.mark.parametrize("alpha,params,ok", [
    ("momentum", {"lookback_days": 63, "min_periods": 50}, True), ("momentum", {"lookback_days": 63, "min_periods": 63}, False),
    ("momentum_acceleration", {"short_lookback_days": 63, "long_lookback_days": 63, "min_periods": 30}, False),
    ("dual_momentum", {"lookback": 126, "risk_free_rate": 0.0, "min_periods": 150}, False),
])
def test_validity(alpha, params, ok):
    assert G.is_valid(alpha, params) is ok


def test_windows():
    w = WF.windows("2016-01-15", "2026-01-29")
    assert w[0] == WF.WindowSpan(0, dt.date(2016, 1, 15), dt.date(2019, 1, 15), dt.date(2019, 1, 15), dt.date(2020, 1, 15))
    assert all(x.test_end <= dt.date(2026, 1, 29) for x in w) and len(w) == 13
    with pytest.raises(ValueError):
        WF.windows("2020-01-01", "2022-01-01")


def test_window_start_clips_and_stays_clipped():
    starts = [str(x.train_start) for x in WF.windows("2015-08-31", "2020-12-31", 2, 1, 6)]
    assert starts[:4] == ["2015-08-31", "2016-02-29", "2016-08-29", "2017-02-28"]


def test_slices(spark):
    days = [dt.date(2020, m, 28) for m in range(1, 13)] + [dt.date(2021, m, 28) for m in range(1, 13)]
    c = spark.createDataFrame([(1, d, None if i == 0 else 0.01 * i) for i, d in enumerate(days)], "strategy_id int, as_of date, returns double")
    span = [WF.WindowSpan(0, dt.date(2020, 3, 1), dt.date(2021, 3, 28), dt.date(2021, 3, 28), dt.date(2021, 9, 1))]
    rows = WF.slice_returns(c, span).collect()
    train = sorted(r.as_of for r in rows if r.phase == "train")
    test = sorted(r.as_of for r in rows if r.phase == "test")
    assert train[0] == dt.date(2020, 4, 28) and train[-1] == dt.date(2021, 3, 28)
    assert test[0] == dt.date(2021, 3, 28) and test[-1] == dt.date(2021, 8, 28)


def test_failed_configs_stay(spark):
    r = spark.createDataFrame([(1, 0, .1, 1.0, .1, .2, 2.0, .1, -.1, .05, .15)],
                              "strategy_id int, window_id int, is_return double, is_sharpe double, is_volatility double, oos_return double, oos_sharpe double, "
                              "oos_volatility double, oos_max_drawdown double, bench_return double, active_return double")
    cfg = spark.createDataFrame([(1,), (2,)], "strategy_id int")
    a = {x.strategy_id: x for x in WF.aggregate(r, cfg).collect()}
    assert a[1].composite_score == pytest.approx(.4 * 10 * .15 + .3 * 2 + .3 * 1)
    assert a[2].num_windows == 0 and a[2].composite_score == float("-inf")


def test_period_composite(spark):
    rows = [(1, 3, .1, .5, True), (1, 5, .2, 1.5, True), (2, 3, .1, .5, True), (2, 5, -.1, .5, True), (3, 3, float("-inf"), float("-inf"), False)]
    df = spark.createDataFrame(rows, "strategy_id int, period int, active_return double, information_ratio double, evaluation_success boolean")
    c = {r.strategy_id: r for r in WF.period_composite(df).collect()}
    assert c[1].composite_score == pytest.approx(1.0 - .5 * .5 + .5) and c[1].beats_all_periods
    assert c[2].composite_score == pytest.approx(.5) and not c[2].beats_all_periods
    assert c[3].composite_score == float("-inf")


def test_trailing_score_needs_twenty_rows(spark):
    d = dt.date(2020, 1, 1)
    rows = [("a", d + dt.timedelta(i), 0.01 * (i % 3)) for i in range(19)] + [("b", d + dt.timedelta(i), 0.01 * (i % 3)) for i in range(120)]
    t = {r.strategy_id: r for r in WF.trailing_score(spark.createDataFrame(rows, "strategy_id string, date date, r double"), 60).collect()}
    assert t["a"].trailing_score == float("-inf") and t["b"].n == 60 and t["b"].trailing_score > 0


def test_grid_equals_single_models(spark):
    """One set of each model through the grid plan, against the model's own operators and backtest."""
    safe, bench = ["Brand#2", "Brand#3"], "Brand#1"
    sets = {}
    for p in G.param_sets(["monthly"]):
        sets.setdefault(p.alpha, p)
    days = schedule_days(START, END, "monthly")
    cal = schedule_table(spark, days)
    bars, mem = bars_from_orders(spark, SF).cache(), members_from_orders(spark, SF)
    marks = asof.markers(mem, days)
    universe = mem.withColumn("universe_no", F.lit(0))
    curves = O.grid_curves(bars, mem, universe, {"monthly": days}, list(sets.values()), bench, safe)
    got = {(r.strategy_id, r.as_of): r.nav for r in curves.collect()}
    assert len(got) == 7 * 3 * 84
    for alpha, p in sets.items():
        q = p.params
        n = q["min_periods"]
        if alpha == "trend_filtered_momentum":
            wide = S.score(bars, marks, [S.momentum(q["momentum_lookback"], n, "x", max(q["momentum_lookback"], q["ma_period"]) + 50)])
            wide = S.trend_filtered(wide, S.trend_flag(bars, marks, bench, q["ma_period"]), "x", safe)
        elif alpha == "dual_momentum":
            wide = S.dual_momentum(S.score(bars, marks, [S.momentum(q["lookback"], n, "x")]), "x", q["lookback"], q["risk_free_rate"], safe)
        elif alpha == "value_momentum":
            wide = S.score(bars, marks, [S.momentum(q["momentum_lookback"], n, "m", 302), S.momentum(252, n, "v", 302)])
            wide = S.value_momentum(wide, "m", "v", q["momentum_weight"], 0.5).withColumnRenamed("blended", "x")
        else:
            sig = p.signals(bench)[0]
            wide = S.score(bars, marks, [sig], benchmark_returns(bars, bench)).withColumnRenamed(sig.name, "x")
        one = accounting.forward_growth(wide).withColumn("strategy_id", G.strategy_key(F.lit(p.param_id), F.lit(0), F.lit(5)))
        w = construction.top_n_equal_weight(one, 5, ["strategy_id", "as_of"], score="x", carry=("growth",))
        for r in accounting.periodic_value(w, cal).collect():
            assert got[(r.strategy_id, r.as_of)] == pytest.approx(r.nav, rel=1e-9), (alpha, r.as_of)
