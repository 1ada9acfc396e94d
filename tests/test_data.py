import datetime as dt

import duckdb
import pytest
from conftest import bars, members
from pyspark.sql import functions as F

from panelwise.functions import dates as DT
from panelwise.functions.exprs import num
from panelwise.operators import monitoring as MON, quality as Q, universe as U
from panelwise.operators.calendar import next_rebalance
from panelwise.plans.catalog import QUERIES, SQL
from panelwise.sources import ingest, panel, state


def test_business_day_arithmetic(spark):
    import pandas as pd

    d = pd.date_range("2023-12-20", "2024-03-10")
    df = spark.createDataFrame([(a.date(), b.date()) for a in d[::5] for b in d[::3] if a <= b], "a date, b date")
    for r in df.select("a", "b", DT.bdays_spanned("a", "b").alias("n"), DT.next_bday("a").alias("nx"), DT.is_month_end_bday("a").alias("me")).collect():
        assert r.n == len(pd.bdate_range(r.a, r.b)) - 1
        assert r.nx == (pd.Timestamp(r.a) + pd.tseries.offsets.BDay(1)).date()
        last = (pd.Timestamp(r.a) + pd.offsets.BMonthEnd(0)).date()
        assert r.me == (r.a == last)


@pytest.mark.parametrize("day,schedule,want", [
    ("2024-01-15", "monthly", "2024-01-31"), ("2024-01-31", "monthly", "2024-02-29"), ("2023-12-29", "monthly", "2024-01-31"), ("2024-01-05", "weekly", "2024-01-12"),
    ("2024-01-06", "weekly", "2024-01-12"), ("2024-01-05", "daily", "2024-01-08"),
])
def test_next_rebalance(spark, day, schedule, want):
    assert str(spark.range(1).select(next_rebalance(F.lit(day).cast("date"), schedule)).first()[0]) == want


def test_schedules(spark):
    get = lambda s: [str(x) for x in spark.range(1).select(DT.schedule_days("2023-09-01", "2023-12-31", s)).first()[0]]
    assert get("monthly") == ["2023-09-29", "2023-10-31", "2023-11-30", "2023-12-29"]
    assert get("month_end")[0] == "2023-09-30" and get("quarter_end") == ["2023-09-30", "2023-12-31"]
    n = [str(x) for x in spark.range(1).select(DT.every_n_bdays("2023-09-01", "2023-09-15", 5)).first()[0]]
    assert n == ["2023-09-01", "2023-09-08", "2023-09-15"]
    with pytest.raises(ValueError):
        DT.schedule_days("2023-01-01", "2023-02-01", "hourly")


def test_quiet_panel_has_no_issue(spark, ramp):
    found = Q.issues(ramp, members(spark, "A", "B", "C"), F.lit("2023-10-27").cast("date"))
    assert found.count() == 0 and Q.overall_status(found).first().overall_status == "OK"
    assert {r.status for r in Q.validate(ramp).collect()} == {"OK"}
    s = Q.quality_score(ramp).first()
    assert (s.total, s.grade) == (100, "A")


def test_issues_are_found(spark):
    px = [100.0] * 30
    px[10] = 130.0
    b = bars(spark, {"A": px, "GAP": [100.0] * 5 + [None] * 12 + [100.0] * 13, "OLD": [100.0] * 10})
    found = {(r.ticker, r.check) for r in Q.issues(b, members(spark, "A", "GAP", "OLD", "NONE"), F.lit("2023-01-30").cast("date")).collect()}
    assert found == {("A", "PRICE_SPIKE"), ("GAP", "GAP"), ("OLD", "STALE"), ("NONE", "STALE")}
    st = {r.ticker: r.days_stale for r in Q.staleness(b, members(spark, "OLD", "NONE"), F.lit("2023-01-30").cast("date")).collect()}
    assert st["NONE"] == 999 and st["OLD"] == 14
    g = Q.gaps(b).first()
    assert (g.ticker, g.max_gap_days, g.gap_count) == ("GAP", 9, 1)


def test_bad_bars(spark):
    b = bars(spark, {"A": [10.0, 11.0, 12.0]})
    neg = b.withColumn("close", F.when(F.col("close") == 11, -1.0).otherwise(F.col("close")))
    assert [r.check for r in Q.bad_prices(neg).collect()] == ["NEGATIVE_PRICE"]
    v = Q.validate(neg).first()
    assert v.negative_prices == 1 and v.status == "INVALID"


def test_drawdown_alerts_are_edges(spark):
    nav = [100, 96, 94, 94, 89, 97, 100, 69]
    rows = [("p", dt.date(2023, 1, i + 1), float(v)) for i, v in enumerate(nav)]
    a = MON.drawdown_alerts(spark.createDataFrame(rows, "portfolio string, date date, nav double"))
    got = [(r.date.day, r.name, r.kind) for r in a.orderBy("date", "threshold").collect()]
    assert got == [(3, "5% Drawdown", "BREACH"), (5, "10% Drawdown", "BREACH"), (6, "5% Drawdown", "RECOVERY"), (6, "10% Drawdown", "RECOVERY"),
                   (8, "5% Drawdown", "BREACH"), (8, "10% Drawdown", "BREACH"), (8, "20% Drawdown", "BREACH"), (8, "30% Drawdown", "BREACH")]
    assert MON.filter_alerts(a, level="CRITICAL").count() == 1
    assert MON.filter_alerts(a, last=3).count() == 3


def test_rounding_is_that_of_sql(spark):
    """Doubles next to a tie: 1 - 1.65 / 160 is printed below 0.9896875 and rounded up all the same."""
    values = [(160 - 1.65) / 160, 0.9896875] + [(p - c / 100) / p for p in (16.0, 32.0, 160.0) for c in range(1, 1600)]
    want = [r[0] for r in duckdb.sql("SELECT round(unnest($v), 6)", params={"v": values}).fetchall()]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").repartition(3)
    assert [r.x for r in df.select("i", num("x").alias("x")).orderBy("i").collect()] == want
    odd = spark.createDataFrame([(float("inf"),), (None,), (1e306,)], "x double").select(num("x").alias("x"))
    assert [r.x for r in odd.collect()] == [float("inf"), None, 1e306]


def test_drawdown_alerts_query_equals_sql_at_a_tie(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, d, 12), v) for d, v in ((1, 160.0), (2, 1.65), (3, 159.0))]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(SQL["drawdown_alerts"]).fetchall()
    assert sorted(map(tuple, QUERIES["drawdown_alerts"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 8


def test_universe_point_in_time(spark):
    u = spark.createDataFrame([("U", "a ", None), ("U", "B", dt.date(2023, 6, 1)), ("V", "C", None)], "name string, ticker string, added_date date")
    get = lambda *a: sorted(r.ticker for r in U.members(u, *a).collect())
    assert get("u") == ["A", "B"] and get("u", "2023-05-31") == ["A"] and get("u", "2023-06-01") == ["A", "B"]
    inst = spark.createDataFrame([("A", dt.date(2023, 1, 1), 5.0), ("B", None, None), ("C", dt.date(2020, 1, 1), 0.5)], "ticker string, inception_date date, aum double")
    assert sorted(r.ticker for r in U.eligible(members(spark, "A", "B", "C", "X"), inst, "2023-06-01", 252, 1.0).collect()) == ["B"]


def test_normalize_bars(spark):
    raw = spark.createDataFrame([
        ("T", "2023-01-02", "1,000.5", "1,001", "999", "1000", "1,200", 1), ("T", "2023-01-02", "2", "2", "2", "2", "bad", 2),
        ("T", "garbage", "1", "1", "1", "1", "1", 3)], "ticker string, Date string, OPEN string, High string, Low string, Close string, Volume string, n int")
    r = ingest.normalize_bars(raw, ["n"]).collect()
    assert len(r) == 1 and r[0].close == 2.0 and r[0].volume is None
    first = ingest.normalize_bars(raw.filter("n = 1"), ["n"]).first()
    assert first.open == 1000.5 and first.volume == 1200
    with pytest.raises(ValueError):
        ingest.normalize_bars(raw.drop("Close"), ["n"])


def test_parsers(spark):
    df = spark.createDataFrame([(" spy ", "0.09%"), ("n a n", "1,234"), ("none", ""), ("b rk", "x%"), (None, None)], "t string, p string")
    got = df.select(ingest.clean_ticker("t").alias("t"), ingest.parse_percent("p").alias("p")).collect()
    assert [r.t for r in got] == ["SPY", None, None, "BRK", None]
    assert [r.p for r in got] == [0.09, 1234.0, None, None, None]


@pytest.mark.parametrize("provider,name,want", [
    ("BlackRock iShares", None, "iShares"), (None, "Vanguard Total", "Vanguard"), ("State Street", "x", "SPDR"), ("PowerShares", None, "Invesco"),
    ("Van Eck", None, "VanEck"), (" Other ", None, "Other"), ("", "SPDR Gold", "SPDR"), (None, None, None),
])
def test_issuer_family(spark, provider, name, want):
    df = spark.createDataFrame([(provider, name)], "p string, n string")
    assert df.select(ingest.issuer_family("p", "n")).first()[0] == want


def test_snapshot_round_trip_and_upsert(spark, ramp, tmp_path):
    path = ingest.write_snapshot(ramp, str(tmp_path), "v1")
    back = panel.load_snapshot(spark, path)
    assert back.count() == 900
    with pytest.raises(Exception):
        ingest.write_snapshot(ramp, str(tmp_path), "v1")
    fix = ramp.filter((F.col("ticker") == "A") & (F.col("date") == "2023-01-05")).withColumn("close", F.lit(1.0))
    up = ingest.upsert(ramp, fix, ["ticker", "date"])
    assert up.count() == 900 and up.filter("close = 1.0").count() == 1


def test_wide_to_long_and_nan(spark):
    wide = spark.createDataFrame([(dt.date(2023, 1, 2), 1.0, float("nan"), 5.0)], "date date, `X.A|Close` double, `B|Close` double, `X.A|Volume` double")
    rows = panel.wide_to_long(wide).collect()
    assert [(r.ticker, r.close, r.volume, r.open) for r in rows] == [("X.A", 1.0, 5.0, None)]


def test_state_table(spark):
    s = spark.createDataFrame([("p", dt.date(2023, 1, 1), 1.0), ("p", dt.date(2023, 2, 1), 2.0)], "portfolio string, as_of date, nav double")
    new = spark.createDataFrame([("p", dt.date(2023, 2, 1), 9.0)], "portfolio string, as_of date, nav double")
    t = state.save_state(s, new)
    assert state.latest_state(t).first().nav == 9.0 and t.count() == 2
    assert state.state_at(t, "2023-01-01").first().nav == 1.0
    assert state.state_history(t, "2023-02-10", 20).count() == 1


def test_feature_store_replaces_a_date(spark, tmp_path):
    f = lambda d, v: spark.createDataFrame([(d, "A", v)], "as_of date, ticker string, x double")
    path = str(tmp_path / "fs")
    state.write_features(f(dt.date(2023, 1, 1), 1.0), path, "d", "n")
    state.write_features(f(dt.date(2023, 1, 2), 2.0), path, "d", "n")
    state.write_features(f(dt.date(2023, 1, 2), 3.0), path, "d", "n")
    assert sorted(r.x for r in state.read_features(spark, path, "d", "n").collect()) == [1.0, 3.0]
    assert state.read_features(spark, path, "d", "n", "2023-01-02").first().x == 3.0


def test_headers_of_published_lists(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], [" Expense Ratio (%)", "Name", "name ", "--", "ISIN-Code"])
    assert ingest.with_plain_headers(df).columns == ["expense_ratio", "name", "name_3", "column_4", "isin_code"]
    a = spark.createDataFrame([(" a ", "x", 1)], ["Ticker ", "NAME", "Position"])
    b = spark.createDataFrame([("A", "EU", 1)], ["ticker", "Region", "position"])
    r = ingest.harmonize(a, b).first()
    assert (r.ticker, r.name, r.region, r.source) == ("A", "x", "EU", "both")


def test_screen_equals_its_parts(spark):
    b = bars(spark, {"A": [10, 10, 30], "B": [1, 2, None], "C": [5, -5, 5]}).withColumn("volume", F.when(F.col("ticker") != "B", F.col("volume")))
    empty = spark.createDataFrame([(dt.date(2023, 1, 1), "D")], "date date, ticker string")
    b = b.unionByName(empty, allowMissingColumns=True)
    parts = Q.validate(b).join(Q.anomaly_counts(b), "ticker").collect()
    want = {r.ticker: (r.ticker != "D", r.status, r.suspicious_days + r.extreme_changes + r.zero_volume) for r in parts}
    assert {r.ticker: (r.kept, r.status, r.anomalies) for r in Q.ingest_screen(b).collect()} == want
    assert want["D"][1] == want["B"][1] == "MISSING" and want["C"][1] == "INVALID" and want["A"][2] == 1
