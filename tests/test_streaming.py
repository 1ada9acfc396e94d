import datetime as dt

import duckdb
import numpy as np

from panelwise.operators import monitoring as MON, regimes as R
from panelwise.plans.catalog import QUERIES, SQL
from panelwise.streaming import runs


def test_drawdown_stream_equals_batch_with_late_rows(spark):
    rng = np.random.default_rng(6)
    d0 = dt.date(2023, 1, 1)
    rows = [(p, d0 + dt.timedelta(i), float(v)) for p in ("x", "y") for i, v in enumerate(100 * np.cumprod(1 + rng.normal(0, .05, 40)))]
    df = spark.createDataFrame(rows, "portfolio string, date date, nav double")
    # The third arrival is older than the second: late, but inside the delay.
    parts = [(None, "2023-01-22"), ("2023-01-23", "2023-01-25"), ("2023-01-22", "2023-01-23"), ("2023-01-25", None)]
    key = ["portfolio", "date", "name", "level", "kind"]
    got = sorted(map(tuple, runs.drawdown_replay(df, parts).select(*key).collect()))
    want = sorted(map(tuple, MON.drawdown_alerts(df).select(*key).collect()))
    assert got == want and len(got) > 10


def test_drawdown_stream_query_equals_sql_at_a_tie(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, d, 12), v) for d, v in ((1, 160.0), (2, 1.65), (3, 159.0))]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(SQL["stream_drawdown_alerts"]).fetchall()
    got = QUERIES["stream_drawdown_alerts"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 8


def test_label_stream_equals_batch(spark):
    rng = np.random.default_rng(12)
    rows = [(dt.date(2023, 1, 1) + dt.timedelta(i), 100 + float(rng.normal(0, 2.5)), 100.0, 22 + float(rng.normal(0, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, "date date, price double, ma double, vix double")
    got = sorted(map(tuple, runs.label_replay(df, [(None, "2023-02-01"), ("2023-02-01", None)]).select("date", "regime").collect()))
    want = sorted(map(tuple, R.hysteresis_labels(df).filter("regime_changed").select("date", "regime").collect()))
    assert got == want


def test_bar_replay_last_write_wins(spark):
    b = lambda v: spark.createDataFrame([(dt.date(2023, 1, 2), "A", v)], "date date, ticker string, close double")
    assert [r.close for r in runs.bar_replay([b(1.0), b(3.0), b(2.0)]).collect()] == [2.0]
