"""Comparison of strategies: pairwise correlation and the test of equal Sharpe ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelwise.functions.exprs import ratio
from panelwise.functions.tdist import t_pvalue
from panelwise.operators.pairwise import BLOCK_SERIES, correlation, pair_moments


def return_correlation(returns: DataFrame, block_series: int = BLOCK_SERIES, pairs: DataFrame | None = None) -> DataFrame:
    """(i, j, n, corr) for every pair of strategies, over their common dates."""
    return correlation(pair_moments(returns, "strategy_id", "r", block_series=block_series, pairs=pairs)).select("i", "j", "n", "corr")


def holdings_correlation(weights: DataFrame, days, window: int | None = None, block_series: int = BLOCK_SERIES, pairs: DataFrame | None = None) -> DataFrame:
    """Correlation of position weights over time among tickers ever held; absent positions count 0.

    Dense rows are tickers ever held x decision dates, which is the matrix the correlation is defined on.
    ``window`` keeps the last decision dates only.
    """
    if window:
        days = F.slice(days, -window, window)
    held = weights.filter(F.col("weight") != 0).groupBy("ticker").agg(F.max("weight").alias("any"))
    grid = held.select("ticker", F.explode(days).alias("date"))
    w = weights.select("ticker", F.col("as_of").alias("date"), "weight")
    dense = grid.join(w, ["ticker", "date"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return correlation(pair_moments(dense, "ticker", "weight", block_series=block_series, pairs=pairs)).select("i", "j", "corr")


def sharpe_test(returns: DataFrame, block_series: int = BLOCK_SERIES, pairs: DataFrame | None = None) -> DataFrame:
    """Sharpe ratios of each pair, their difference statistic and its two-sided p-value.

    A non-positive variance estimate falls back to the paired t statistic; both have n - 1 degrees of freedom.
    """
    m = correlation(pair_moments(returns, "strategy_id", "r", block_series=block_series, pairs=pairs)).filter(F.col("n") >= 2)
    n = F.col("n")

    def var(q: str, s: str):
        return (F.col(q) - F.col(s) * F.col(s) / n) / (n - 1.0)

    m = m.withColumns({"v1": var("q_i", "s_i"), "v2": var("q_j", "s_j"), "m1": F.col("s_i") / n, "m2": F.col("s_j") / n})
    m = m.withColumns({
        "sharpe_1": F.when(F.col("v1") > 0, F.col("m1") / F.sqrt("v1")).otherwise(0.0),
        "sharpe_2": F.when(F.col("v2") > 0, F.col("m2") / F.sqrt("v2")).otherwise(0.0),
    })
    s1, s2, rho = F.col("sharpe_1"), F.col("sharpe_2"), F.col("corr")
    theta = (2.0 - 2.0 * rho * F.sqrt(ratio("v1", "v2")) - 0.5 * s1 * s1 - 0.5 * s2 * s2 + s1 * s2 * rho) / n
    diff_var = F.col("v1") + F.col("v2") - 2.0 * rho * F.sqrt(F.col("v1") * F.col("v2"))
    paired = ratio(F.col("m1") - F.col("m2"), F.sqrt(diff_var / n))
    t = F.when(theta > 0, (s1 - s2) / F.sqrt(theta)).otherwise(paired)
    out = m.withColumn("t_statistic", F.when((F.col("v1") > 0) & (F.col("v2") > 0), t))
    out = out.withColumn("p_value", t_pvalue(F.col("t_statistic"), n - 1.0))
    return out.select(
        "i", "j", n.cast("long").alias("n"), "sharpe_1", "sharpe_2", "t_statistic", "p_value",
        F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("is_significant"),
    )
