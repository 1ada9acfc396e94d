import datetime as dt

import pandas as pd
import pytest
from conftest import bars, days_array, members
from pyspark.sql import functions as F

from panelwise.operators import asof


@pytest.mark.parametrize("day", ["2023-03-01", "2023-07-15", "2023-10-01"])
def test_read_is_strictly_before(ramp, day):
    last = asof.read_prices(ramp, day).agg(F.max("date"), F.max("close")).first()
    d = dt.date.fromisoformat(day)
    assert last[0] == d - dt.timedelta(days=1)
    assert last[1] == 100 + (d - dt.date(2023, 1, 1)).days - 1


@pytest.mark.parametrize("n", [1, 30, 100])
def test_lookback_counts_calendar_days(ramp, n):
    got = asof.read_prices(ramp, "2023-08-01", n).filter("ticker = 'A'")
    assert got.count() == n
    assert got.agg(F.min("date")).first()[0] == dt.date(2023, 8, 1) - dt.timedelta(days=n)


def test_range_is_inclusive(ramp):
    r = asof.read_range(ramp, "2023-02-01", "2023-02-10").filter("ticker = 'B'")
    assert r.count() == 10


def test_unknown_and_availability(spark, ramp):
    want = members(spark, "A", "ZZZ")
    assert [r.ticker for r in asof.unknown_tickers(want, ramp).collect()] == ["ZZZ"]
    got = {r.ticker: r.available for r in asof.availability(want, ramp, "2023-02-01").collect()}
    assert got == {"A": True, "ZZZ": False}


def test_as_of_exclusive_and_inclusive(spark, ramp):
    marks = asof.markers(members(spark, "A"), days_array("2022-12-31", "2023-01-01", "2023-01-02", "2024-06-01"))
    ex = {str(r.as_of): r.close for r in asof.as_of(ramp, marks, ["ticker"], ["close"]).collect()}
    inc = {str(r.as_of): r.close for r in asof.as_of(ramp, marks, ["ticker"], ["close"], inclusive=True).collect()}
    assert ex == {"2022-12-31": None, "2023-01-01": None, "2023-01-02": 100.0, "2024-06-01": 399.0}
    assert inc == {"2022-12-31": None, "2023-01-01": 100.0, "2023-01-02": 101.0, "2024-06-01": 399.0}


def test_observe_equals_plain_slicing(spark):
    """Both ends of each span against pandas, on a series with holes."""
    px = [None if i % 7 in (5, 6) or i % 11 == 3 else 50 + (i * 37 % 29) for i in range(200)]
    b = bars(spark, {"A": px, "B": [p and p + 1 for p in px[::-1]]})
    marks = asof.markers(members(spark, "A", "B"), days_array("2023-01-03", "2023-03-15", "2023-05-20", "2023-12-01"))
    spans = [(5, 20), (30, 60), (None, 60), (10, None)]
    got = asof.observe(b, marks, spans).toPandas()
    src = b.toPandas().sort_values("date")
    for _, r in got.iterrows():
        h = src[(src.ticker == r.ticker) & (src.date < r.as_of)]
        assert (r["last"] is None and h.empty) or r["last"].close == h.close.iloc[-1]
        for rows, days in spans:
            w = h if days is None else h[h.date >= r.as_of - dt.timedelta(days=days)]
            w = w.iloc[-rows:] if rows else w
            cell = r[asof.span_name(rows, days)]
            if w.empty:
                assert cell is None
            else:
                assert cell.date == w.date.iloc[0] and cell.close == w.close.iloc[0]
                assert r["last"].seq - cell.seq + 1 == len(w)
                rets = w.close.pct_change().dropna()
                assert r["last"].n_r - cell.n_r == len(rets)
                assert abs((r["last"].s_r - cell.s_r) - rets.sum()) < 1e-9


def test_panel_row_is_strict(spark):
    b = bars(spark, {"A": [1, 2, 3, 4], "B": [5, 6, None, None]})
    marks = asof.markers(members(spark, "A", "B", "Z"), days_array("2023-01-01", "2023-01-03", "2023-01-04"))
    got = {(r.ticker, str(r.as_of)): (r.panel_date and str(r.panel_date), r.close) for r in asof.panel_row(b, marks, ["close"]).collect()}
    assert got[("A", "2023-01-01")] == (None, None) and got[("Z", "2023-01-03")] == ("2023-01-02", None)
    assert got[("B", "2023-01-03")] == ("2023-01-02", 6.0)
    assert got[("A", "2023-01-04")] == ("2023-01-03", 3.0) and got[("B", "2023-01-04")] == ("2023-01-03", None)
    loose = {(r.ticker, str(r.as_of)): r.close for r in asof.as_of(b, marks, ["ticker"], ["close"]).collect()}
    assert loose[("B", "2023-01-04")] == 6.0 and len(got) == len(loose) == 9
    same_day = asof.panel_row(b, marks, ["close"], inclusive=True).filter("ticker = 'A' AND as_of = DATE '2023-01-01'").first()
    assert same_day.close == 1.0
    assert asof.panel_row(b.limit(0), marks, ["close"]).filter("close IS NOT NULL").count() == 0


def test_forward_fill(spark):
    df = spark.createDataFrame([("A", 1, None), ("A", 2, 1.0), ("A", 3, None), ("B", 1, 7.0), ("B", 2, None)], "k string, date int, v double")
    got = {(r.k, r.date): r.v for r in asof.forward_fill(df, ["k"], "v").collect()}
    assert got == {("A", 1): None, ("A", 2): 1.0, ("A", 3): 1.0, ("B", 1): 7.0, ("B", 2): 7.0}
