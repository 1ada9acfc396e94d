"""Return and price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelwise.functions.exprs import change
from panelwise.functions.joins import bounded


def daily_returns(bars: DataFrame, key: str = "ticker", price: str = "close") -> DataFrame:
    """(date, key, price, prev_date, r); r is NULL on a series' first row."""
    w = Window.partitionBy(key).orderBy("date")
    px = bars.filter(F.col(price).isNotNull())
    return px.select(
        "date", key, price, F.lag("date").over(w).alias("prev_date"), change(price, F.lag(price).over(w)).alias("r")
    )


def benchmark_prices(bars: DataFrame, ticker: str) -> DataFrame:
    """(date, price): the benchmark close; a panel without the benchmark gives the cross-sectional mean close.

    One partial aggregate by day; whether the benchmark exists is then a one-row aggregate over the days.
    """
    own = F.max(F.when(F.col("ticker") == ticker, F.col("close")))
    daily = bars.groupBy("date").agg(own.alias("own"), F.avg("close").alias("mean_close"))
    exists = daily.agg(F.coalesce(F.bool_or(F.col("own").isNotNull()), F.lit(False)).alias("exists"))
    price = F.when(F.col("exists"), F.col("own")).otherwise(F.col("mean_close"))
    return daily.join(bounded(exists, 1)).select("date", price.alias("price")).filter(F.col("price").isNotNull())


def benchmark_returns(bars: DataFrame, ticker: str) -> DataFrame:
    """(date, r) of the benchmark, one row per day."""
    return daily_returns(bars.filter(F.col("ticker") == ticker)).filter(F.col("r").isNotNull()).select("date", "r")
