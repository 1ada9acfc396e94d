import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwise.functions.tdist import two_sided
from panelwise.operators import benchmarks as B, comparison, metrics as M, pairwise, rolling as W, accounting
from panelwise.functions.dates import schedule_table
from conftest import days_array

N = 300


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    idx = pd.date_range("2022-01-03", periods=N, freq="B")
    b = rng.normal(0.0004, 0.01, N)
    return pd.DataFrame({"b": b, "s": 0.5 * b + rng.normal(0.0006, 0.012, N)}, index=idx)


@pytest.fixture(scope="module")
def rows(spark, series):
    data = [(n, d.date(), float(v)) for n in ("s", "b") for d, v in series[n].items()]
    return spark.createDataFrame(data, "strategy_id string, date date, r double").cache()


def test_performance_matches_formulas(rows, series):
    p = M.performance(rows, 252, 0.02).filter("strategy_id = 's'").first()
    r = series.s
    eq = (1 + r).cumprod()
    dd = eq / eq.cummax() - 1
    x = r - 0.02 / 252
    var = r.quantile(0.05)
    under = dd < 0
    want = dict(
        n=N, total_return=eq.iloc[-1] - 1, cagr=eq.iloc[-1] ** (252 / N) - 1, volatility=r.std() * 252**.5,
        sharpe=r.mean() / r.std() * 252**.5, sortino=x.mean() * 252 / (x[x < 0].std() * 252**.5), calmar=r.mean() * 252 / -dd.min(),
        max_drawdown=dd.min(), win_rate=(r > 0).mean() * 100, var=var, cvar=r[r <= var].mean(),
        tail_ratio=abs(np.percentile(r, 95)) / abs(np.percentile(r, 5)), max_drawdown_duration=under.groupby((~under).cumsum()).sum().max())
    for k, v in want.items():
        assert p[k] == pytest.approx(v), k


def test_performance_edges(spark):
    d = [dt.date(2023, 1, i) for i in (2, 3, 4)]
    df = spark.createDataFrame(
        [("flat", x, 0.0) for x in d] + [("up", x, 0.01 * (i + 1)) for i, x in enumerate(d)] + [("one", d[0], 0.1)],
        "strategy_id string, date date, r double")
    p = {r.strategy_id: r for r in M.performance(df).collect()}
    assert p["flat"].sharpe == 0 and p["flat"].sortino == 0 and p["flat"].calmar == 0
    assert p["up"].sortino == float("inf") and p["up"].calmar == float("inf") and p["up"].max_drawdown_duration == 0
    assert p["one"].sharpe == 0 and p["one"].cagr == 0


def test_active_metrics(rows, series):
    bench = rows.filter("strategy_id = 'b'").select("date", "r")
    a = M.active(rows.filter("strategy_id = 's'"), bench, 252, 0.01).first()
    s, b = series.s, series.b
    x = s - b
    beta = s.cov(b) / b.var()
    assert a.beta == pytest.approx(beta)
    assert a.alpha == pytest.approx(((s.mean() - .01 / 252) - beta * (b.mean() - .01 / 252)) * 252)
    assert a.tracking_error == pytest.approx(x.std() * 252**.5)
    assert a.information_ratio == pytest.approx(x.mean() * 252 / (x.std() * 252**.5))
    assert a.active_return == pytest.approx((1 + s).prod() - (1 + b).prod())
    assert a.win_rate == pytest.approx((x > 0).mean() * 100)


def test_active_against_itself(rows):
    bench = rows.filter("strategy_id = 'b'").select("date", "r")
    a = M.active(rows.filter("strategy_id = 'b'"), bench).first()
    assert a.beta == pytest.approx(1) and a.tracking_error == 0 and a.information_ratio == 0 and a.win_rate == 0


def test_rolling(rows, series):
    r = rows.filter("strategy_id = 's'").withColumnRenamed("strategy_id", "ticker")
    got = W.rolling_sharpe(r).orderBy("date").toPandas().rolling_sharpe
    roll = series.s.rolling(252, min_periods=126)
    np.testing.assert_allclose(got.astype(float), (roll.mean() / roll.std() * 252**.5).to_numpy())
    got = W.rolling_volatility(r).orderBy("date").toPandas().rolling_vol
    np.testing.assert_allclose(got.astype(float), (series.s.rolling(21).std() * 252**.5).to_numpy())


def test_concentration_and_exposure(spark):
    d = [dt.date(2023, 1, i) for i in (1, 2, 3)]
    w = spark.createDataFrame([("s", d[0], "A", .5), ("s", d[0], "B", .5), ("s", d[1], "A", 1.0), ("s", d[2], "B", 0.0), ("s", d[2], "C", .4)],
                              "strategy_id string, as_of date, ticker string, weight double")
    c = {r.as_of: r for r in M.concentration(w).collect()}
    assert c[d[0]].herfindahl == pytest.approx(.5) and c[d[0]].effective_n == pytest.approx(2) and c[d[2]].effective_n == pytest.approx(1)
    e = {r.ticker: r for r in M.exposure_summary(w, 3).collect()}
    dense = np.array([.5, 1.0, 0.0])
    assert e["A"].avg_weight == pytest.approx(dense.mean()) and e["A"].weight_std == pytest.approx(dense.std(ddof=1))
    assert e["B"].min_weight_nonzero == .5 and e["B"].hold_frequency == pytest.approx(1 / 3)


def test_cycles(spark):
    d = [dt.date(2023, m, 1) for m in (1, 2, 3, 4)]
    v = spark.createDataFrame([("s", x, n, b) for x, n, b in zip(d, (100., 110., 99., 120.), (50., 52., 50., 51.))],
                              "strategy_id string, as_of date, nav double, bench double")
    c = M.cycles(v)
    assert [r.is_win for r in c.orderBy("start_date").collect()] == [True, False, True]
    s = M.cycle_summary(c, 0.6).first()
    assert s.total_cycles == 3 and s.win_rate == pytest.approx(2 / 3) and s.meets_criterion
    assert s.best_start == d[2] and s.worst_start == d[1]


def test_drawdown_episodes(spark):
    nav = [100, 101, 95, 90, 102, 101.5, 80, 81]
    d = pd.date_range("2023-01-01", periods=8)
    c = spark.createDataFrame([("s", x.date(), float(v)) for x, v in zip(d, nav)], "strategy_id string, date date, nav double")
    e = M.drawdown_episodes(c, "nav").orderBy("start").collect()
    assert [(str(r.start), str(r.end), r.days) for r in e] == [("2023-01-03", "2023-01-04", 1), ("2023-01-07", "2023-01-08", 1)]
    assert e[1].max_dd == pytest.approx(80 / 102 - 1)


@pytest.mark.parametrize("block_series", [1, 2, 1000])
def test_pairwise_correlation_with_gaps(spark, block_series):
    rng = np.random.default_rng(5)
    d = pd.date_range("2022-12-01", periods=80)
    m = pd.DataFrame(rng.normal(size=(80, 7)), index=d, columns=list("ABCDEFG"))
    m[rng.random(m.shape) < .25] = np.nan
    rows = [(c, x.date(), float(v)) for c in m for x, v in m[c].items() if v == v]
    df = spark.createDataFrame(rows, "strategy_id string, date date, r double")
    got = {(r.i, r.j): r.corr for r in comparison.return_correlation(df, block_series).collect()}
    want = m.corr()
    assert len(got) == 21
    for (i, j), v in got.items():
        assert i < j and v == pytest.approx(want.loc[i, j])
    some = spark.createDataFrame([("A", "C"), ("B", "G"), ("A", "C"), ("A", "Z")], "i string, j string")
    kept = {(r.i, r.j): r.corr for r in comparison.return_correlation(df, block_series, some).collect()}
    assert kept == pytest.approx({k: got[k] for k in [("A", "C"), ("B", "G")]})


def test_t_pvalues():
    t = np.array([0.1, 0.5, 1.0, 3.0, 12.0])
    # One and three degrees of freedom have closed forms.
    np.testing.assert_allclose(two_sided(t, np.full(5, 1.0)), 1 - 2 * np.arctan(t) / np.pi, rtol=1e-9)
    u = t / np.sqrt(3)
    np.testing.assert_allclose(two_sided(t, np.full(5, 3.0)), 1 - 2 * (u / (1 + u * u) + np.arctan(u)) / np.pi, rtol=1e-9)
    # Table values of Student's distribution.
    got = two_sided(np.array([2.228138852, 1.959963985, 0.0, 3.169272673]), np.array([10.0, 1e7, 5.0, 10.0]))
    np.testing.assert_allclose(got, [0.05, 0.05, 1.0, 0.01], rtol=1e-6)


def test_sharpe_test_is_symmetric_in_sign(rows, series):
    r = comparison.sharpe_test(rows).first()
    a, b = series.b, series.s
    n, rho = N, a.corr(b)
    s1, s2 = a.mean() / a.std(), b.mean() / b.std()
    theta = (2 - 2 * rho * np.sqrt(a.var() / b.var()) - .5 * s1**2 - .5 * s2**2 + s1 * s2 * rho) / n
    assert (r.i, r.j, r.n) == ("b", "s", N)
    assert r.t_statistic == pytest.approx((s1 - s2) / np.sqrt(theta))
    assert 0 < r.p_value <= 1


def test_ewma_covariance(spark):
    rng = np.random.default_rng(9)
    d = pd.date_range("2023-01-02", periods=60, freq="B")
    m = pd.DataFrame(rng.normal(size=(60, 3)), index=d, columns=list("ABC"))
    m.iloc[::7, 1] = np.nan
    r = spark.createDataFrame([(x.date(), c, float(v)) for c in m for x, v in m[c].items() if v == v], "date date, ticker string, r double")
    got = {(x.i, x.j): x.cov for x in pairwise.ewma_covariance(r, days_array("2023-03-20"), 20, 30).collect()}
    end = pd.Timestamp("2023-03-20")
    w = m.loc[end - pd.tseries.offsets.BDay(30):end].fillna(0.0)
    lam = 0.5 ** (1 / 20)
    k = np.array([lam**i for i in range(len(w) - 1, -1, -1)])
    k /= k.sum()
    x = w.to_numpy() - (k[:, None] * w.to_numpy()).sum(0)
    cov = (x.T * k) @ x
    for (i, j), v in got.items():
        assert v == pytest.approx(cov["ABC".index(i), "ABC".index(j)])
    assert len(got) == 6


def test_random_selection_against_brute_force(spark):
    """Every trial's curve from its own draws, by a loop; draws are n distinct names and repeatable."""
    days = ["2023-01-31", "2023-02-28", "2023-03-31"]
    rng = np.random.default_rng(11)
    px = {t: rng.uniform(50, 150, 3) for t in "ABCDE"}
    rows = [(t, dt.date.fromisoformat(d), float(px[t][i]), float(px[t][i + 1] / px[t][i]) if i < 2 else None) for t in px for i, d in enumerate(days)]
    p = spark.createDataFrame(rows, "ticker string, as_of date, price double, growth double")
    w = B.random_selection(p, 2, 6)
    picks = w.groupBy("strategy_id", "as_of").agg(F.collect_set("ticker").alias("t")).collect()
    assert len(picks) == 18 and all(len(r.t) == 2 for r in picks)
    curves = B.value(w, schedule_table(spark, days_array(*days)))
    got = {(r.strategy_id, str(r.as_of)): r.nav for r in curves.collect()}
    chosen = {(r.strategy_id, str(r.as_of)): r.t for r in picks}
    last = []
    for k in range(6):
        nav = 100000.0
        for i, d in enumerate(days):
            assert got[(f"random:{k}", d)] == pytest.approx(nav)
            if i < 2:
                nav *= np.mean([px[t][i + 1] / px[t][i] for t in chosen[(f"random:{k}", d)]])
        last.append(nav)
    s = {str(r.as_of): r for r in B.random_summary(curves).collect()}
    assert s[days[2]].nav == pytest.approx(np.mean(last)) and s[days[2]].std == pytest.approx(np.std(last, ddof=1))
    assert sorted(w.select("strategy_id", "as_of", "ticker").collect()) == sorted(B.random_selection(p, 2, 6).select("strategy_id", "as_of", "ticker").collect())


def test_daily_value_against_loop(spark):
    d = pd.date_range("2023-01-02", "2023-01-31", freq="B")
    rng = np.random.default_rng(4)
    r = {(x.date(), t): float(rng.normal(0, .02)) for x in d for t in "AB"}
    rets = spark.createDataFrame([(k[0], k[1], v) for k, v in r.items()], "date date, ticker string, r double")
    cal = schedule_table(spark, days_array("2023-01-06", "2023-01-20"))
    tw = {dt.date(2023, 1, 6): {"A": 1.0}, dt.date(2023, 1, 20): {"A": .5, "B": .5}}
    w = spark.createDataFrame([("s", a, t, v) for a, m in tw.items() for t, v in m.items()], "strategy_id string, as_of date, ticker string, weight double")
    cost = spark.createDataFrame([("s", dt.date(2023, 1, 20), .01)], "strategy_id string, as_of date, cost double")
    got = {x.date: x.equity for x in accounting.daily_value(w, rets, cal, cost, "2023-01-02", "2023-01-31").collect()}
    eq, held = 1.0, {}
    for x in d:
        x = x.date()
        ret = sum(v * r[(x, t)] for t, v in held.items())
        if x == dt.date(2023, 1, 23):
            ret -= .01
        eq *= 1 + ret
        assert got[x] == pytest.approx(eq)
        held = tw.get(x, held)


def test_benchmark_falls_back_to_the_mean(spark):
    from conftest import bars
    from panelwise.operators.returns import benchmark_prices

    b = bars(spark, {"A": [1, 2], "B": [3, 6]})
    assert [r.price for r in benchmark_prices(b, "A").orderBy("date").collect()] == [1.0, 2.0]
    assert [r.price for r in benchmark_prices(b, "Z").orderBy("date").collect()] == [2.0, 4.0]
    assert benchmark_prices(b.limit(0), "A").count() == 0


def test_experiment_bundle(spark):
    days = pd.date_range("2020-01-31", periods=4, freq="ME").date
    curve = spark.createDataFrame(
        [("s", d, v, 1.5, r) for d, v, r in zip(days, (100.0, 110.0, 99.0, 108.9), (None, 0.1, -0.1, 0.1))],
        "strategy_id string, as_of date, nav double, cost double, returns double")
    bench = spark.createDataFrame([(days[1], 0.05), (days[2], -0.05)], "date date, r double")
    r = accounting.experiment_bundle(curve, bench, 12.0).first()
    assert (r.num_rebalances, r.total_costs) == (4, 6.0)
    assert r.total_return == pytest.approx(0.089) and r.max_drawdown == pytest.approx(-0.1) and r.win_rate == pytest.approx(200 / 3)
    assert r.cagr == pytest.approx(1.089 ** 4 - 1) and r.active_return == pytest.approx(1.1 * 0.9 - 1.05 * 0.95)
    assert accounting.experiment_bundle(curve, bench.limit(0), 12.0).first().tracking_error is None
