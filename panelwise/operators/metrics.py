"""Performance and risk statistics per strategy.

Input ``returns`` is (strategy_id, date, r). Every function does its windows and its aggregate on the same
partitioning, so one shuffle by strategy serves all statistics. One strategy has one row per period at most.
Standard deviations, variances and covariances are sample ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.exprs import change, ratio
from panelwise.functions.joins import DAYS, bounded

INF = float("inf")


def _by(keys: Sequence[str] = ("strategy_id",)):
    return Window.partitionBy(*keys).orderBy("date")


def growth_path(returns: DataFrame, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Add ``equity`` (compounded growth), ``drawdown`` and ``below`` (rows since the last peak)."""
    run = _by(keys).rowsBetween(Window.unboundedPreceding, 0)
    r = returns.filter(F.col("r").isNotNull()).withColumn("equity", F.product(1.0 + F.col("r")).over(run))
    return drawdown_path(r, "equity", keys)


def drawdown_path(curve: DataFrame, value: str, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    run = _by(keys).rowsBetween(Window.unboundedPreceding, 0)
    d = curve.withColumns({"drawdown": change(F.col(value), F.max(value).over(run)), "_rn": F.row_number().over(_by(keys))})
    peak = F.last(F.when(F.col("drawdown") >= 0, F.col("_rn")), ignorenulls=True).over(run)
    return d.withColumn("below", F.col("_rn") - peak).drop("_rn")


def _sharpe(r: Column, ppy: float) -> Column:
    return F.coalesce(ratio(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(float(ppy))), F.lit(0.0))


def _sortino(r: Column, ppy: float, rf: float) -> Column:
    x = r - rf / ppy
    down = F.when(x < 0, x)
    value = ratio(F.avg(x) * ppy, F.stddev_samp(down) * F.sqrt(F.lit(float(ppy))))
    return (
        F.when(F.count(x) < 2, 0.0)
        .when(F.count(down) == 0, F.when(F.avg(x) > 0, INF).otherwise(0.0))
        .otherwise(F.coalesce(value, F.lit(0.0)))
    )


def _cagr(final: Column, n: Column, ppy: float) -> Column:
    return F.when(n >= 2, F.pow(final, F.lit(float(ppy)) / n) - 1.0).otherwise(0.0)


def performance(
    returns: DataFrame, periods_per_year: float = 252.0, risk_free: float = 0.0, confidence: float = 0.95, tail: float = 0.05
) -> DataFrame:
    """One row per strategy: growth, risk-adjusted ratios, tail risk and drawdown statistics."""
    ppy, whole = float(periods_per_year), Window.partitionBy("strategy_id")
    p = growth_path(returns).withColumn("_var", F.percentile("r", F.lit(1.0 - confidence)).over(whole))
    r, n = F.col("r"), F.count("r")
    final, mdd = F.max_by("equity", "date"), F.min("drawdown")
    ann = F.avg(r) * ppy
    hi, lo = F.percentile("r", F.lit(1.0 - tail)), F.percentile("r", F.lit(tail))
    return p.groupBy("strategy_id").agg(
        n.alias("n"),
        (final - 1.0).alias("total_return"),
        _cagr(final, n, ppy).alias("cagr"),
        (F.stddev_samp(r) * F.sqrt(F.lit(ppy))).alias("volatility"),
        _sharpe(r, ppy).alias("sharpe"),
        _sortino(r, ppy, risk_free).alias("sortino"),
        F.when(n < 2, 0.0).when(mdd == 0, F.when(ann > 0, INF).otherwise(0.0)).otherwise(ratio(ann, F.abs(mdd))).alias("calmar"),
        mdd.alias("max_drawdown"),
        F.max("below").alias("max_drawdown_duration"),
        (F.avg((r > 0).cast("double")) * 100.0).alias("win_rate"),
        F.first("_var").alias("var"),
        F.coalesce(F.avg(F.when(r <= F.col("_var"), r)), F.first("_var")).alias("cvar"),
        F.when(lo == 0, F.when(hi > 0, INF).otherwise(0.0)).otherwise(ratio(F.abs(hi), F.abs(lo))).alias("tail_ratio"),
    )


def aligned(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Strategy and benchmark returns of common dates. ``benchmark``: (date, r), one row per day, hence the broadcast."""
    b = benchmark.filter(F.col("r").isNotNull()).groupBy("date").agg(F.first("r").alias("b"))
    return returns.filter(F.col("r").isNotNull()).join(bounded(b, DAYS), "date")


def active(
    returns: DataFrame, benchmark: DataFrame, periods_per_year: float = 252.0, risk_free: float = 0.0,
    keys: Sequence[str] = ("strategy_id",),
) -> DataFrame:
    """Strategy, benchmark and active statistics over the common dates."""
    ppy, rf = float(periods_per_year), risk_free / periods_per_year
    a = aligned(returns, benchmark)
    run = _by(keys).rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumns({"se": F.product(1.0 + F.col("r")).over(run), "be": F.product(1.0 + F.col("b")).over(run)})
    a = a.withColumns({"sd": change(F.col("se"), F.max("se").over(run)), "bd": change(F.col("be"), F.max("be").over(run))})
    r, b, x, n = F.col("r"), F.col("b"), F.col("r") - F.col("b"), F.count("*")
    s_final, b_final = F.max_by("se", "date"), F.max_by("be", "date")
    beta = F.coalesce(ratio(F.covar_samp("r", "b"), F.var_samp("b")), F.lit(0.0))
    alpha = F.when(F.stddev_samp("b") > 0, ((F.avg(r) - rf) - beta * (F.avg(b) - rf)) * ppy).otherwise(0.0)
    te = F.stddev_samp(x) * F.sqrt(F.lit(ppy))
    return a.groupBy(*keys).agg(
        n.alias("n"),
        (s_final - 1.0).alias("strategy_total_return"),
        _sharpe(r, ppy).alias("strategy_sharpe"),
        _sortino(r, ppy, risk_free).alias("strategy_sortino"),
        F.min("sd").alias("strategy_max_dd"),
        _cagr(s_final, n, ppy).alias("strategy_cagr"),
        (b_final - 1.0).alias("benchmark_total_return"),
        _sharpe(b, ppy).alias("benchmark_sharpe"),
        _sortino(b, ppy, risk_free).alias("benchmark_sortino"),
        F.min("bd").alias("benchmark_max_dd"),
        _cagr(b_final, n, ppy).alias("benchmark_cagr"),
        (s_final - b_final).alias("active_return"),
        (F.avg(x) * ppy).alias("active_return_ann"),
        te.alias("tracking_error"),
        F.coalesce(ratio(F.avg(x) * ppy, te), F.lit(0.0)).alias("information_ratio"),
        beta.alias("beta"),
        alpha.alias("alpha"),
        (_sharpe(r, ppy) - _sharpe(b, ppy)).alias("sharpe_difference"),
        (F.avg((x > 0).cast("double")) * 100.0).alias("win_rate"),
    )


def attribution(returns: DataFrame, benchmarks: DataFrame, periods_per_year: float = 252.0) -> DataFrame:
    """Every strategy against every benchmark: excess, tracking error, information ratio, beta, alpha.

    ``benchmarks``: (benchmark, date, r) for a few named curves; the equi-join is on date.
    """
    ppy = float(periods_per_year)
    b = benchmarks.filter(F.col("r").isNotNull()).select("benchmark", "date", F.col("r").alias("b"))
    j = returns.filter(F.col("r").isNotNull()).join(b, "date")
    x = F.col("r") - F.col("b")
    te = F.stddev_samp(x) * F.sqrt(F.lit(ppy))
    beta = F.coalesce(ratio(F.covar_samp("r", "b"), F.var_samp("b")), F.lit(0.0))
    return j.groupBy("strategy_id", "benchmark").agg(
        (F.avg(x) * ppy).alias("excess_return"), te.alias("tracking_error"),
        F.coalesce(ratio(F.avg(x) * ppy, te), F.lit(0.0)).alias("information_ratio"),
        beta.alias("beta"), ((F.avg("r") - beta * F.avg("b")) * ppy).alias("alpha"), F.count("*").alias("n"),
    ).filter(F.col("n") >= 2)


def concentration(weights: DataFrame) -> DataFrame:
    """Herfindahl index and effective number of holdings per portfolio; zero weights drop out."""
    s, q = F.sum("weight"), F.sum(F.col("weight") * F.col("weight"))
    hhi = ratio(q, s * s)
    return weights.filter(F.col("weight") != 0).groupBy("strategy_id", "as_of").agg(
        hhi.alias("herfindahl"), ratio(F.lit(1.0), hhi).alias("effective_n")
    )


def exposure_summary(weights: DataFrame, n_dates: int | Column, reference: DataFrame | None = None) -> DataFrame:
    """Weight statistics per ticker over ``n_dates`` portfolios; absent positions count as 0 without densifying."""
    n = F.lit(n_dates).cast("double") if isinstance(n_dates, int) else n_dates.cast("double")
    s, q = F.sum("weight"), F.sum(F.col("weight") * F.col("weight"))
    out = weights.groupBy("strategy_id", "ticker").agg(
        (s / n).alias("avg_weight"),
        F.max("weight").alias("max_weight"),
        F.min(F.when(F.col("weight") != 0, F.col("weight"))).alias("min_weight_nonzero"),
        (F.count_if(F.col("weight") > 0) / n).alias("hold_frequency"),
        F.sqrt(F.greatest(ratio(q - s * s / n, n - 1.0), F.lit(0.0))).alias("weight_std"),
    )
    return out if reference is None else out.join(reference, "ticker", "left")


def drawdown_episodes(curve: DataFrame, value: str, threshold: float = 0.01) -> DataFrame:
    """(strategy_id, start, end, max_dd, days) of every stretch more than ``threshold`` below the peak."""
    d = drawdown_path(curve, value)
    deep = F.col("drawdown") < -threshold
    d = d.withColumn("_in", deep)
    starts = deep & ~F.coalesce(F.lag("_in").over(_by()), F.lit(False))
    run = _by().rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_id", F.sum(starts.cast("int")).over(run)).filter("_in")
    return d.groupBy("strategy_id", "_id").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.min("drawdown").alias("max_dd"),
        F.datediff(F.max("date"), F.min("date")).alias("days"),
    ).drop("_id")


def underwater(curve: DataFrame, value: str) -> DataFrame:
    d = drawdown_path(curve, value)
    low = F.col("drawdown") < 0
    return d.groupBy("strategy_id").agg(
        F.count("*").alias("total_days"), F.count_if(low).alias("underwater_days"),
        (F.count_if(low) / F.count("*")).alias("pct_underwater"), F.max("below").alias("longest_streak"),
        F.coalesce(F.avg(F.when(low, F.col("drawdown"))), F.lit(0.0)).alias("avg_depth"),
    )


def period_returns(curve: DataFrame, value: str, unit: str) -> DataFrame:
    """Return from one period's last value to the next's; ``unit`` is month or year."""
    per = curve.groupBy("strategy_id", F.trunc("date", unit).alias("date")).agg(F.max_by(value, "date").alias("v"))
    return per.select("strategy_id", F.col("date").alias("period"), change(F.col("v"), F.lag("v").over(_by())).alias("r"))


def month_grid(monthly: DataFrame) -> DataFrame:
    """Year rows, one column per calendar month."""
    names = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    return monthly.groupBy("strategy_id", F.year("period").alias("year")).agg(
        *[F.max(F.when(F.month("period") == i, F.col("r"))).alias(m) for i, m in enumerate(names, 1)]
    )


def cycles(values: DataFrame) -> DataFrame:
    """(strategy_id, as_of, nav, bench) at every rebalance -> one row per interval between two of them."""
    by = Window.partitionBy("strategy_id").orderBy("as_of")
    c = values.select(
        "strategy_id", F.col("as_of").alias("start_date"), F.lead("as_of").over(by).alias("end_date"),
        change(F.lead("nav").over(by), F.col("nav")).alias("strat_return"),
        change(F.lead("bench").over(by), F.col("bench")).alias("bench_return"),
    ).filter(F.col("end_date").isNotNull())
    c = c.withColumn("active_return", F.col("strat_return") - F.col("bench_return"))
    return c.withColumn("is_win", F.col("active_return") > 0)


def cycle_summary(cycle_rows: DataFrame, threshold: float = 0.80) -> DataFrame:
    a, win = F.col("active_return"), F.col("is_win")
    rate = F.count_if(win) / F.count("*")
    return cycle_rows.groupBy("strategy_id").agg(
        F.count("*").alias("total_cycles"), F.count_if(win).alias("winning_cycles"), F.count_if(~win).alias("losing_cycles"),
        rate.alias("win_rate"), F.avg(a).alias("avg_active_return"),
        F.coalesce(F.avg(F.when(win, a)), F.lit(0.0)).alias("avg_win_return"),
        F.coalesce(F.avg(F.when(~win, a)), F.lit(0.0)).alias("avg_loss_return"),
        F.max(a).alias("best_active_return"), F.min_by("start_date", F.struct(-a, F.col("start_date"))).alias("best_start"),
        F.min(a).alias("worst_active_return"), F.min_by("start_date", F.struct(a, F.col("start_date"))).alias("worst_start"),
        (rate >= threshold).alias("meets_criterion"),
    )
