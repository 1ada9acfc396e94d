"""Stored states, run logs, snapshots and macro files: versions, refusals, pruning, round trips."""

import datetime as dt

import pytest
from conftest import bars
from pyspark.errors import PySparkException

from panelwise.sources import book, ingest, results
from panelwise.sources.panel import read_macro, read_snapshot, write_macro

D = dt.date
STATE = "portfolio string, as_of date, nav double, peak_nav double, holdings map<string,double>, weights map<string,double>, cost_basis map<string,double>, regime string, drawdown_level string"


def state(spark, *rows):
    full = [(p, d, nav, peak, h, w, c, "NORMAL", "NONE") for p, d, nav, peak, h, w, c in rows]
    return spark.createDataFrame(full, STATE)


A1 = ("a", D(2020, 12, 31), 100.0, 120.0, {"X": 5.0}, {"X": 0.5, "$CASH$": 0.5}, {"X": 9.0})
A2 = ("a", D(2021, 1, 29), 110.0, 120.0, {"Y": 2.0}, {"Y": 1.0}, {"Y": 50.0})
B1 = ("b", D(2021, 1, 29), 0.0, 0.0, {}, {}, {})


def test_newest_version_wins_and_days_are_as_of(spark, tmp_path):
    path = f"{tmp_path}/book"
    book.append(state(spark, A1, A2, B1), path, 1)
    book.append(state(spark, (*A2[:2], 90.0, 130.0, {"Y": 1.0, "Z": 3.0}, {"Y": 0.4, "Z": 0.6}, {"Y": 50.0, "Z": 7.0})), path, 2)
    now = {(r.portfolio, r.as_of): r for r in book.read(spark, path).collect()}
    assert len(now) == 3 and now["a", D(2021, 1, 29)].nav == 90.0 and now["a", D(2021, 1, 29)].holdings == {"Y": 1.0, "Z": 3.0}
    assert {(r.portfolio, r.as_of) for r in book.at(spark, path, "2021-01-15").collect()} == {("a", D(2020, 12, 31))}
    assert {r.portfolio: r.nav for r in book.latest(book.read(spark, path)).collect()} == {"a": 90.0, "b": 0.0}
    dd = {(r.portfolio, r.as_of): round(r.drawdown, 6) for r in book.drawdown(book.read(spark, path)).collect()}
    assert dd == {("a", D(2020, 12, 31)): round(20 / 120, 6), ("a", D(2021, 1, 29)): round(40 / 130, 6), ("b", D(2021, 1, 29)): 0.0}
    with pytest.raises(PySparkException):
        book.append(state(spark, A1), path, 1)


def test_only_years_asked_for_are_read(spark, tmp_path):
    path = f"{tmp_path}/book"
    book.append(state(spark, A1, A2, B1), path, 1)
    plan = book.read(spark, path, first="2021-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan
    assert book.read(spark, path, first="2021-01-01", last="2021-12-31").count() == 2


@pytest.mark.parametrize("row", [
    ("a", D(2021, 1, 1), -1.0, 1.0, {}, {}, {}), ("a", D(2021, 1, 1), 1.0, -1.0, {}, {}, {}), ("a", D(2021, 1, 1), None, 1.0, {}, {}, {}),
    ("a", D(2021, 1, 1), 1.0, 1.0, {"X": -2.0}, {}, {}), ("a", D(2021, 1, 1), 1.0, 1.0, {}, {}, {"X": -2.0})])
def test_negative_values_are_refused(spark, row):
    with pytest.raises(PySparkException, match="must not be"):
        book.checked(state(spark, row)).collect()


def test_missing_columns(spark):
    r = book.checked(spark.createDataFrame([("a", D(2021, 1, 1), 1.0, 2.0)], "portfolio string, as_of date, nav double, peak_nav double")).first()
    assert r.holdings == {} and r.regime is None
    with pytest.raises(ValueError):
        book.checked(spark.createDataFrame([("a", 1.0)], "portfolio string, nav double"))


def test_drift_and_gain(spark):
    targets = spark.createDataFrame([("a", "X", 0.51), ("a", "Q", 0.3)], "portfolio string, ticker string, weight double")
    got = {r.ticker: round(r.drift, 6) for r in book.drift(state(spark, A1), targets).collect()}
    assert got == {"Q": 0.3, "$CASH$": -0.5}
    prices = spark.createDataFrame([(D(2020, 12, 31), "X", 12.0)], "as_of date, ticker string, price double")
    gains = book.unrealized(state(spark, A1), prices).first()
    assert (gains.cost, gains.value) == (45.0, 60.0) and gains.gain == pytest.approx(1 / 3)


def test_json_round_trip_and_refusals(spark):
    s = state(spark, A1, A2, B1)
    back = book.from_json(book.to_json(s))
    assert sorted(map(str, back.collect())) == sorted(map(str, s.collect()))
    for text in ('{"portfolio": "a", "as_of": "2021-01-01", "nav": 1, "peak_nav": 1, "extra": 3}', "[1, 2]", "not json", None,
                 '{"portfolio": "a", "as_of": "2021-01-01", "nav": -1, "peak_nav": 1}'):
        with pytest.raises(PySparkException):
            book.from_json(spark.createDataFrame([(text,)], "state string")).collect()


def test_run_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    configs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "strategy_id long, config_name string")
    done = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.7, -0.1)], "strategy_id long, composite_score double, oos_active_return_mean double")
    out = results.outcomes(configs, done)
    assert {r.config_name: r.status for r in out.collect()} == {"one": "ok", "two": "ok", "three": "failed"}
    assert results.summary(out).first().asDict() == {"n_configs": 3, "n_failed": 1, "n_winners": 1, "best_score": 0.7}
    results.append({"all": out, "winners": results.winners(out)}, path, "r1", 1)
    results.append({"all": out.limit(0)}, path, "r2", 1)
    results.append({"all": out.filter("strategy_id = 3")}, path, "r1", 2)
    results.append({"all": out}, path, "r3", 10)
    assert sorted((r.run_id, r.version, r.config_name) for r in results.read(spark, path, "all").collect()) == [
        ("r1", 2, "three"), ("r3", 10, "one"), ("r3", 10, "three"), ("r3", 10, "two")]
    assert results.read(spark, path, "all", ["r3"]).count() == 3 and results.read(spark, path, "winners").first().config_name == "one"
    with pytest.raises(PySparkException):
        results.append({"all": out}, path, "r1", 2)
    with pytest.raises(ValueError):
        results.append({"other": out}, path, "r1", 3)


def test_best_of_equivalent_configurations(spark):
    """Scores that differ in rounding noise only are ties, whatever the order of rows; failed ones are never best."""
    rows = [(7, "c", 459.01037204225730), (5, "a", 459.01037204225713), (6, "b", 459.01037204225722), (4, "low", 1.0), (1, "failed", None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "strategy_id long, config_name string, composite_score double").repartition(3)
        assert results.best(df).first().config_name == "a"
    assert results.best(df.where("strategy_id = 1")).first().config_name is None


def test_snapshot_and_macro_files(spark, tmp_path):
    b = bars(spark, {"A": list(range(1, 800)), "B": list(range(1, 500))}, start="2020-01-01")
    path = ingest.write_snapshot(b, f"{tmp_path}/panel", "1")
    got = read_snapshot(spark, path, "2021-01-01", "2021-01-31")
    assert got.count() == 62 and set(got.columns) == set(b.columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(date)" in plan
    with pytest.raises(ValueError):
        read_snapshot(spark, f"{path}/year=2020")
    m = spark.createDataFrame([("VIX", D(2020, 1, 2), 20.0), ("VIX", D(2020, 1, 3), float("nan")), ("CPI", D(2020, 1, 1), 1.0)], "indicator string, date date, value double")
    write_macro(m, f"{tmp_path}/macro")
    assert {(r.indicator, r.value) for r in read_macro(spark, f"{tmp_path}/macro").collect()} == {("VIX", 20.0), ("VIX", None), ("CPI", 1.0)}
    assert read_macro(spark, f"{tmp_path}/macro", ["CPI"]).first().value == 1.0
    with pytest.raises(PySparkException):
        read_macro(spark, f"{tmp_path}/macro", ["NONE"])
