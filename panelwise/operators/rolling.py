"""Rolling statistics over row frames, per series. A frame is at most a few hundred rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelwise.functions.exprs import ratio


def _frame(window: int, key: str):
    return Window.partitionBy(key).orderBy("date").rowsBetween(-(window - 1), 0)


def moving_average(df: DataFrame, value: str, window: int, key: str = "ticker") -> DataFrame:
    w = _frame(window, key)
    return df.withColumn("ma", F.when(F.count(value).over(w) == window, F.avg(value).over(w)))


def rolling_sharpe(
    returns: DataFrame, window: int = 252, min_periods: int = 126, risk_free: float = 0.0, key: str = "ticker"
) -> DataFrame:
    """Scaled by sqrt(window); NULL below ``min_periods`` or without variation."""
    r = returns.filter(F.col("r").isNotNull())
    w = _frame(window, key)
    value = ratio(F.avg("r").over(w) - risk_free / 252.0, F.stddev_samp("r").over(w)) * F.sqrt(F.lit(float(window)))
    return r.withColumn("rolling_sharpe", F.when(F.count("r").over(w) >= min_periods, value))


def rolling_volatility(returns: DataFrame, window: int = 21, key: str = "ticker") -> DataFrame:
    r = returns.filter(F.col("r").isNotNull())
    w = _frame(window, key)
    full = F.count("r").over(w) == window
    return r.withColumn("rolling_vol", F.when(full, F.stddev_samp("r").over(w) * F.sqrt(F.lit(252.0))))


def rolling_correlation(pairs: DataFrame, a: str, b: str, window: int = 63, key: str = "ticker") -> DataFrame:
    p = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    w = _frame(window, key)
    full = F.count(a).over(w) == window
    # corr divides by the deviations; a flat frame has none and is NULL.
    varied = (F.stddev_samp(a).over(w) > 0) & (F.stddev_samp(b).over(w) > 0)
    return p.withColumn("rolling_corr", F.when(full & varied, F.corr(a, b).over(w)))


def rolling_compound(returns: DataFrame, value: str, out: str, window: int = 252, key: str = "ticker") -> DataFrame:
    w = _frame(window, key)
    full = F.count(value).over(w) == window
    return returns.withColumn(out, F.when(full, F.product(1.0 + F.col(value)).over(w) - 1.0))


def rolling_win_rate(pairs: DataFrame, window: int = 252, key: str = "ticker") -> DataFrame:
    """Share of full windows in which the compounded return beats the benchmark's. ``pairs``: (key, date, r, b)."""
    both = pairs.filter(F.col("r").isNotNull() & F.col("b").isNotNull())
    both = rolling_compound(rolling_compound(both, "r", "roll_r", window, key), "b", "roll_b", window, key)
    return both.filter(F.col("roll_r").isNotNull()).groupBy(key).agg(
        F.avg((F.col("roll_r") > F.col("roll_b")).cast("double")).alias("rolling_win_rate"), F.count("*").alias("n_windows")
    )


def macro_position(macro: DataFrame, lookback_days: int = 252, min_z: int = 20, min_pct: int = 5) -> DataFrame:
    """Trailing z-score and percentile of each value among those of the last ``lookback_days`` calendar days, itself included."""
    day = macro.withColumn("_d", F.unix_date("date"))
    w = Window.partitionBy("indicator").orderBy("_d").rangeBetween(-lookback_days, 0)
    n, sd = F.count("value").over(w), F.stddev_samp("value").over(w)
    z = ratio(F.col("value") - F.avg("value").over(w), sd)
    # One indicator has one value per day: the frame, and so the array, is at most lookback_days + 1 long.
    d = day.withColumns({
        "n": n, "zscore": F.when(n >= min_z, z), "_vals": F.collect_list("value").over(w),
    })
    below = F.size(F.filter("_vals", lambda v: v <= F.col("value")))
    return d.withColumn("percentile", F.when(F.col("n") >= min_pct, 100.0 * below / F.col("n"))).drop("_vals", "_d")
