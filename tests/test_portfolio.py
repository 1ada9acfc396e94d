import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise import CASH
from panelwise.functions.dates import schedule_table
from panelwise.operators import accounting, construction as C, costs, overlays as O, trades as T
from conftest import days_array

D = [dt.date(2023, 1, 31), dt.date(2023, 2, 28), dt.date(2023, 3, 31), dt.date(2023, 4, 28)]


def scores(spark, table):
    rows = [("s", d, t, v) for d, m in table.items() for t, v in m.items()]
    return spark.createDataFrame(rows, "strategy_id string, as_of date, ticker string, score double")


def test_top_n_fills_with_cash_and_breaks_ties_by_ticker(spark):
    sc = scores(spark, {D[0]: {"A": 1.0, "B": 1.0, "C": 2.0, "D": None}, D[1]: {"A": 0.5, "B": None, "C": None, "D": None},
                        D[2]: {"A": None, "B": None, "C": None, "D": None}})
    got = {(r.as_of, r.ticker): r.weight for r in C.top_n_equal_weight(sc, 2, ["strategy_id", "as_of"]).collect()}
    assert got == {(D[0], "C"): 0.5, (D[0], "A"): 0.5, (D[1], "A"): 0.5, (D[1], CASH): 0.5, (D[2], CASH): 1.0}


def test_clip_renormalises(spark):
    w = spark.createDataFrame([("s", D[0], "A", 0.7), ("s", D[0], "B", 0.2), ("s", D[0], "C", 0.1)], "strategy_id string, as_of date, ticker string, weight double")
    got = {r.ticker: r.weight for r in C.clip_weights(w, ["strategy_id", "as_of"], 0.0, 0.4).collect()}
    assert got["A"] == pytest.approx(0.4 / 0.7) and sum(got.values()) == pytest.approx(1)


def pairs(spark, rows):
    return spark.createDataFrame([("s", D[0], t, a, b) for t, a, b in rows], "strategy_id string, as_of date, ticker string, prev_w double, next_w double")


MOVES = [("SPY", 0.5, 0.2), ("ARKK", 0.0, 0.3), ("B", 0.5, 0.5)]


def test_cost_models_closed_form(spark):
    p = pairs(spark, MOVES)
    get = lambda df: df.first().cost
    assert get(costs.flat(p, 10)) == pytest.approx(0.3 * 0.001)
    dw = np.array([0.3, 0.3])
    assert get(costs.slippage(p, 5, 2)) == pytest.approx(((5 + dw * 200) * dw).sum() / dw.sum() / 1e4)
    table = spark.createDataFrame(list(costs.DEFAULT_SPREADS.items()), "ticker string, spread_bps double")
    assert get(costs.spread(p, table)) == pytest.approx((1.0 * 0.3 + 15 * 0.3) / 0.6 / 1e4)
    assert get(costs.impact(p, 5)) == pytest.approx(5 * np.sqrt(0.3) / 1e4)
    assert get(costs.impact(p, 5, times_turnover=True)) == pytest.approx(5 * np.sqrt(0.3) / 1e4 * 0.3)
    still = pairs(spark, [("A", 0.5, 0.5)])
    assert get(costs.slippage(still)) == 0.0
    with pytest.raises(ValueError):
        costs.flat(p, -1)


def test_value_curve_equals_event_loop(spark):
    """The running product against a date-by-date loop with shares, cash and costs."""
    rng = np.random.default_rng(3)
    names = ["A", "B", "C", CASH]
    px = {d: {**{n: float(p) for n, p in zip("ABC", rng.uniform(50, 150, 3))}, CASH: 1.0} for d in D}
    targets = {d: dict(zip(names, w)) for d, w in zip(D, ([.4, .6, 0, 0], [0, .5, .25, .25], [0, 0, 0, 1.0], [.2, .3, .5, 0]))}
    rows = []
    for i, d in enumerate(D):
        for n, w in targets[d].items():
            if w:
                g = None if n == CASH or i == 3 else px[D[i + 1]][n] / px[d][n]
                rows.append(("s", d, n, w, g))
    w = spark.createDataFrame(rows, "strategy_id string, as_of date, ticker string, weight double, growth double")
    cal = schedule_table(spark, days_array(*map(str, D)))
    got = accounting.periodic_value(w, cal, 25.0).orderBy("as_of").collect()
    nav, held, prev, want = 100000.0, {CASH: 100000.0}, {CASH: 1.0}, []
    for d in D:
        nav = sum(q * px[d][n] for n, q in held.items())
        turn = 0.5 * sum(abs(targets[d].get(n, 0) - prev.get(n, 0)) for n in names)
        cost = nav * turn * 0.0025
        nav -= cost
        held = {n: nav * v / px[d][n] for n, v in targets[d].items()}
        prev = targets[d]
        want.append((nav, cost))
    for r, (nav, cost) in zip(got, want):
        assert r.nav == pytest.approx(nav) and r.cost == pytest.approx(cost)
    free = accounting.periodic_value(w, cal, 0.0).orderBy("as_of").collect()
    assert free[-1].nav > got[-1].nav


def test_run_parts_start_in_cash(spark):
    """A run over part of the calendar pays its own first trade and stops at its own end."""
    rows = [("r", d, "A", 1.0, 1.1, D[1], D[2]) for d in D[1:3]]
    w = spark.createDataFrame(rows, "strategy_id string, as_of date, ticker string, weight double, growth double, run_start date, run_end date")
    got = accounting.periodic_value(w, schedule_table(spark, days_array(*map(str, D))), 100.0).orderBy("as_of").collect()
    assert [r.as_of for r in got] == D[1:3]
    assert got[0].nav == pytest.approx(99000) and got[1].nav == pytest.approx(99000 * 1.1)


W = "strategy_id string, as_of date, ticker string, weight double"


def test_position_limit_one_pass(spark):
    w = spark.createDataFrame([("s", D[0], t, v) for t, v in (("A", .5), ("B", .2), ("C", .2), ("D", .1))], W)
    got = {r.ticker: r.weight for r in O.position_limit(w, 0.25).collect()}
    assert got == pytest.approx({"A": .25, "B": .25, "C": .25, "D": .1 + .25 * .1 / .5})


@pytest.mark.parametrize("nav,level,factor", [(95, "NONE", 1.0), (90, "SOFT", .75), (80, "HARD", .5), (70, "EXIT", .25)])
def test_drawdown_breaker(spark, nav, level, factor):
    w = spark.createDataFrame([("s", D[0], "A", 1.0)], W)
    st = spark.createDataFrame([("s", D[0], float(nav), 100.0)], "strategy_id string, as_of date, nav double, peak_nav double")
    r = O.drawdown_breaker(w, st).first()
    assert (r.breaker_level, r.weight) == (level, factor)


def test_breaker_without_state(spark):
    w = spark.createDataFrame([("s", D[0], "A", 1.0)], W)
    st = spark.createDataFrame([], "strategy_id string, as_of date, nav double, peak_nav double")
    assert O.drawdown_breaker(w, st).first().weight == 1.0


@pytest.mark.parametrize("vix,share", [(20.0, 0.0), (25.0, .25), (35.0, .5)])
def test_volatility_regime(spark, vix, share):
    w = spark.createDataFrame([("s", D[0], "A", .6), ("s", D[0], "AGG", .4)], W)
    v = spark.createDataFrame([(D[0], vix)], "as_of date, vix double")
    got = {r.ticker: r.weight for r in O.volatility_regime(w, v).collect()}
    assert got["A"] == pytest.approx(.6 * (1 - share)) and got["AGG"] == pytest.approx(.4 + share / 5)
    assert len(got) == (6 if share else 2)


def test_share_trades_actions(spark):
    s = "strategy_id string, as_of date, ticker string, weight double, shares double, price double"
    cur = spark.createDataFrame([("s", D[0], "A", .5, 10.0, 5.0), ("s", D[0], "B", .5, 4.0, 2.0)], s)
    tgt = spark.createDataFrame([("s", D[0], "A", .5, 10.005, 5.0), ("s", D[0], "C", .5, 3.0, 7.0)], s)
    pairs_ = T.align(cur, tgt, T.SHARE_FIELDS)
    got = {r.ticker: (r.action, r.notional_value) for r in T.share_trades(pairs_).collect()}
    assert got["A"][0] == "HOLD" and got["B"] == ("SELL", 8.0) and got["C"] == ("BUY", 21.0)


def test_configured_overlays(spark):
    """Two configurations side by side; overlays that are off change nothing and leave no diagnostics."""
    d = dt.date(2020, 6, 30)
    w = spark.createDataFrame([("s", d, "A", 0.6), ("s", d, "B", 0.3), ("s", d, "DEF", 0.1)], "strategy_id string, as_of date, ticker string, weight double")
    none = spark.createDataFrame([], "date date, ticker string, r double, prev_date date")
    states = spark.createDataFrame([("s", d, 75.0, 100.0)], "strategy_id string, as_of date, nav double, peak_nav double")
    vix = spark.createDataFrame([(d, 35.0)], "as_of date, vix double")
    cols = "strategy_id string, config string, max_weight double, soft double, hard double, exit double, high_vix double, elevated_vix double"
    configs = spark.createDataFrame([("s", "off", None, None, None, None, None, None), ("s", "limit", 0.4, None, None, None, None, None),
                                     ("s", "all", 0.4, 0.1, 0.2, 0.3, 30.0, 25.0), ("other", "x", 0.1, None, None, None, None, None)], cols)
    got = {}
    for r in O.configured(w, configs, none, states, vix, ["DEF"]).collect():
        got.setdefault(r.config, {})[r.ticker] = (round(r.weight, 6), r.diagnostics, r.levels)
    assert {t: v[0] for t, v in got["off"].items()} == {"A": 0.6, "B": 0.3, "DEF": 0.1} and got["off"]["A"][1:] == ({}, {})
    assert {t: v[0] for t, v in got["limit"].items()} == {"A": 0.4, "B": 0.4, "DEF": 0.15}
    # Limit, then half the exposure for a drawdown of a quarter, then half of what is left to the defensive ticker.
    assert {t: v[0] for t, v in got["all"].items()} == {"A": 0.1, "B": 0.1, "DEF": round(0.075 + 0.5, 6)}
    assert got["all"]["A"][1] == {"excess_weight": pytest.approx(0.2), "drawdown": 0.25, "exposure_factor": 0.5, "defensive_share": 0.5}
    assert got["all"]["A"][2] == {"breaker_level": "HARD", "vix_level": "HIGH_VOL"} and "x" not in got
    with pytest.raises(ValueError):
        O.configured(w, configs.withColumn("no_such", F.lit(1.0)), none, states, vix)
