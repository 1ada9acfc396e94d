"""Registered queries: a signal, a cost and a check that a user registers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwise.functions.exprs import num
from panelwise.operators import construction, custom
from panelwise.operators.returns import daily_returns
from panelwise.plans.catalog.portfolio_q import monthly
from panelwise.plans.catalog.signals_q import WEIGHTS_SQL, month_marks, momentum_weights
from panelwise.plans.registry import query
from panelwise.plans.sqlkit import with_ctes
from panelwise.sources.panel import bars_from_orders


@custom.register("signal", "median_return")
def median_return(bars: DataFrame, marks: DataFrame, lookback: int = 63, min_periods: int = 50) -> DataFrame:
    """Median daily return of the last rows; a median has no running form, so it runs per window in pandas."""
    def score(window: pd.DataFrame) -> float | None:
        r = window["r"].tail(lookback)
        return float(r.median()) if len(r) >= min_periods else None

    rets = daily_returns(bars).filter(F.col("r").isNotNull()).select("ticker", "date", "r")
    return custom.per_window(rets, marks, lookback + 50, score)


@custom.register("cost", "ticket_and_spread")
def ticket_and_spread(paired: DataFrame, ticket: float = 0.0001, bps: float = 5.0) -> DataFrame:
    """A fixed part for each name that trades, and a rate on what is traded; cash trades are free."""
    traded = F.when(F.col("ticker") != "$CASH$", F.abs(F.col("next_w") - F.col("prev_w"))).otherwise(0.0)
    return paired.groupBy("strategy_id", "as_of").agg(
        (F.sum(F.when(traded > 1e-9, ticket).otherwise(0.0)) + F.sum(traded) * bps / 10_000.0).alias("cost"))


@custom.register("check", "thin_volume")
def thin_volume(bars: DataFrame, share: float = 0.1) -> DataFrame:
    """Days whose volume is below a share of the ticker's mean volume."""
    mean = F.avg("volume").over(Window.partitionBy("ticker"))
    return bars.withColumn("m", mean).filter(F.col("volume") < share * F.col("m")).select("ticker", "date", F.lit("thin_volume").alias("issue"))


@query("custom_signal_scores", with_ctes(
    "rets members rebal",
    "SELECT m.ticker, r.as_of, round(s.score, 6) AS score FROM members m CROSS JOIN rebal r LEFT JOIN "
    "(SELECT ticker, as_of, CASE WHEN count(*) >= 50 THEN median(r) END AS score FROM (SELECT m.ticker, r.as_of, b.r, row_number() OVER (PARTITION BY m.ticker, r.as_of ORDER BY b.date DESC) AS k "
    "FROM members m CROSS JOIN rebal r JOIN rets b ON b.ticker = m.ticker AND b.r IS NOT NULL AND b.date < r.as_of AND b.date >= r.as_of - 113) WHERE k <= 63 GROUP BY 1, 2) s USING (ticker, as_of)"))
def custom_signal_scores(spark: SparkSession, root: str) -> DataFrame:
    out = custom.apply("signal", "median_return", bars_from_orders(spark, root), month_marks(spark, root))
    return out.select("ticker", "as_of", num("score").alias("score"))


@query("custom_cost", with_ctes(
    "px", "SELECT 'momentum' AS strategy_id, as_of, round(sum(CASE WHEN t > 1e-9 THEN 0.0001 ELSE 0 END) + sum(t) * 0.0005, 6) AS cost FROM "
    "(SELECT as_of, CASE WHEN ticker <> '$CASH$' THEN abs(next_w - prev_w) ELSE 0 END AS t FROM pair) GROUP BY as_of", **WEIGHTS_SQL))
def custom_cost(spark: SparkSession, root: str) -> DataFrame:
    paired = construction.paired(momentum_weights(spark, root), monthly(spark))
    return custom.apply("cost", "ticket_and_spread", paired).select("strategy_id", "as_of", num("cost").alias("cost"))


@query("custom_check_issues", with_ctes(
    "bars", "SELECT ticker, date, 'thin_volume' AS issue FROM (SELECT *, avg(volume) OVER (PARTITION BY ticker) AS m FROM bars) WHERE volume < 0.1 * m"))
def custom_check_issues(spark: SparkSession, root: str) -> DataFrame:
    return custom.apply("check", "thin_volume", bars_from_orders(spark, root))
