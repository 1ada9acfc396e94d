"""Walk-forward windows, per-window metrics and their aggregation."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.exprs import change, ratio, sig, struct_array
from panelwise.functions.joins import CONFIGS, bounded


@dataclass(frozen=True)
class WindowSpan:
    window_id: int
    train_start: dt.date
    train_end: dt.date
    test_start: dt.date
    test_end: dt.date


def _add_months(d: dt.date, months: int) -> dt.date:
    """Calendar month shift; a day past the end of the month becomes its last day."""
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    last = (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(y, m + 1, min(d.day, last))


def windows(
    start: str | dt.date, end: str | dt.date, train_years: int = 3, test_years: int = 1, step_months: int = 6, min_windows: int = 1
) -> list[WindowSpan]:
    """Rolling train/test spans until the test end passes ``end``. The start moves step by step, so a clipped day stays clipped."""
    a, b = (d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in (start, end))
    if (b - a).days < (train_years + test_years) * 365:
        raise ValueError("not enough data for one window")
    out: list[WindowSpan] = []
    while True:
        mid = _add_months(a, 12 * train_years)
        stop = _add_months(mid, 12 * test_years)
        if stop > b:
            break
        out.append(WindowSpan(len(out), a, mid, mid, stop))
        a = _add_months(a, step_months)
    if len(out) < min_windows:
        raise ValueError(f"need {min_windows} windows, got {len(out)}")
    return out


def window_array(spans: list[WindowSpan]) -> Column:
    """The windows as a constant array of structs, so that joining them to rows is an explode."""
    fields = ["window_id", "train_start", "train_end", "test_start", "test_end"]
    return F.expr(struct_array(fields, [tuple(getattr(s, f) for f in fields) for s in spans]))


def slice_returns(curve: DataFrame, spans: list[WindowSpan]) -> DataFrame:
    """(strategy_id, window_id, phase, as_of, r): one continuous curve cut into train and test, both ends included.

    A window's own run starts in cash at its first rebalance, which has no return; so the return there is dropped
    from the window, and the test part inherits the train holdings.
    """
    by = Window.partitionBy("strategy_id").orderBy("as_of")
    c = curve.select("strategy_id", "as_of", "returns", F.lag("as_of").over(by).alias("prev_as_of")).filter(F.col("returns").isNotNull())
    w = c.select("strategy_id", "as_of", F.col("returns").alias("r"), F.inline(F.filter(
        window_array(spans),
        lambda s: (F.col("prev_as_of") >= s["train_start"]) & (F.col("as_of") <= s["test_end"]))))
    phases = F.array_compact(F.array(
        F.when(F.col("as_of") <= F.col("train_end"), F.lit("train")), F.when(F.col("as_of") >= F.col("test_start"), F.lit("test"))
    ))
    return w.select("strategy_id", "window_id", F.explode(phases).alias("phase"), "as_of", "r")


def slice_metrics(rows: DataFrame, periods_per_year: float | str = 252.0) -> DataFrame:
    """Total return, annualised-return Sharpe, volatility and drawdown per (strategy, window, phase).

    ``periods_per_year`` is a number or the name of a column that is constant in each strategy.
    One shuffle by strategy serves every window: the growth path is a window over (strategy, window, phase).
    """
    own = isinstance(periods_per_year, str)
    ppy = F.first(periods_per_year) if own else F.lit(float(periods_per_year))
    keys = ["strategy_id", "window_id", "phase"]
    run = Window.partitionBy(*keys).orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    p = rows.withColumn("cum", F.product(1.0 + F.col("r")).over(run))
    p = p.withColumn("dd", change(F.col("cum"), F.max("cum").over(run)))
    m = p.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max_by("cum", "as_of") - 1.0).alias("total_return"),
        (F.stddev_samp("r") * F.sqrt(ppy)).alias("volatility"), F.min("dd").alias("max_drawdown"), ppy.alias("ppy"),
    )
    enough = F.col("n") >= 2
    ann = F.pow(1.0 + F.col("total_return"), F.col("ppy") / F.col("n")) - 1.0
    zero = F.lit(0.0)
    return m.select(
        *keys, "n", F.when(enough, F.col("total_return")).otherwise(zero).alias("total_return"),
        F.when(enough, F.col("volatility")).otherwise(zero).alias("volatility"),
        F.when(enough & (F.col("volatility") > 0), ratio(ann, "volatility")).otherwise(zero).alias("sharpe"),
        F.when(enough, F.col("max_drawdown")).otherwise(zero).alias("max_drawdown"),
    )


def benchmark_by_window(prices: DataFrame, spans: list[WindowSpan]) -> DataFrame:
    """(window_id, bench_return): last over first price in [test_start, test_end); 0 with fewer than two. ``prices``: (date, price)."""
    w = prices.select("date", "price", F.inline(F.filter(
        window_array(spans), lambda s: (F.col("date") >= s["test_start"]) & (F.col("date") < s["test_end"]))))
    g = change(F.max_by("price", "date"), F.min_by("price", "date"))
    return w.groupBy("window_id").agg(F.when(F.count("*") >= 2, g).otherwise(0.0).alias("bench_return"))


def window_results(metrics: DataFrame, bench: DataFrame) -> DataFrame:
    """One row per (strategy, window): in-sample and out-of-sample metrics side by side, active return."""
    def pick(phase: str, col: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("phase") == phase, F.col(col))), F.lit(0.0))

    w = metrics.groupBy("strategy_id", "window_id").agg(
        pick("train", "total_return").alias("is_return"), pick("train", "sharpe").alias("is_sharpe"), pick("train", "volatility").alias("is_volatility"),
        pick("test", "total_return").alias("oos_return"), pick("test", "sharpe").alias("oos_sharpe"),
        pick("test", "volatility").alias("oos_volatility"), pick("test", "max_drawdown").alias("oos_max_drawdown"),
    )
    j = w.join(bounded(bench, CONFIGS), "window_id", "left").withColumn("bench_return", F.coalesce("bench_return", F.lit(0.0)))
    return j.withColumn("active_return", F.col("oos_return") - F.col("bench_return"))


def aggregate(results: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Means over windows, degradation and the composite .4*10*active + .3*Sharpe + .3*win rate.

    With ``configs`` a configuration that has no window stays, with a score of minus infinity.
    """
    win = F.avg((F.col("active_return") > 0).cast("double"))
    a = results.groupBy("strategy_id").agg(
        F.count("*").alias("num_windows"), F.avg("oos_sharpe").alias("oos_sharpe_mean"),
        F.coalesce(F.stddev_samp("oos_sharpe"), F.lit(0.0)).alias("oos_sharpe_std"), F.avg("oos_return").alias("oos_return_mean"),
        F.avg("active_return").alias("oos_active_return_mean"), win.alias("oos_win_rate"),
        F.avg("is_sharpe").alias("is_sharpe_mean"), F.avg("is_return").alias("is_return_mean"),
    )
    a = a.withColumns({
        "sharpe_degradation": F.col("is_sharpe_mean") - F.col("oos_sharpe_mean"),
        "return_degradation": F.col("is_return_mean") - F.col("oos_return_mean"),
        "composite_score": 0.4 * 10.0 * F.col("oos_active_return_mean") + 0.3 * F.col("oos_sharpe_mean") + 0.3 * F.col("oos_win_rate"),
    })
    if configs is None:
        return a
    worst = F.lit(float("-inf"))
    return configs.join(a, "strategy_id", "left").withColumns({
        "num_windows": F.coalesce("num_windows", F.lit(0)), "oos_sharpe_mean": F.coalesce("oos_sharpe_mean", worst),
        "composite_score": F.coalesce("composite_score", worst),
    })


def stability(results: DataFrame) -> DataFrame:
    """In-sample against out-of-sample summary: means, deviations, medians, degradation, shares, variation."""
    med = F.lit(0.5)
    diff, rdiff = F.col("is_sharpe") - F.col("oos_sharpe"), F.col("is_return") - F.col("oos_return")

    def share(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    return results.groupBy("strategy_id").agg(
        F.count("*").alias("num_windows"),
        *[f.alias(f"{p}_sharpe_{n}") for p in ("is", "oos") for n, f in (
            ("mean", F.avg(f"{p}_sharpe")), ("std", F.stddev_samp(f"{p}_sharpe")), ("median", F.percentile(f"{p}_sharpe", med)),
            ("cv", F.abs(ratio(F.stddev_samp(f"{p}_sharpe"), F.avg(f"{p}_sharpe")))))],
        F.avg("is_return").alias("is_return_mean"), F.avg("oos_return").alias("oos_return_mean"),
        F.avg("is_drawdown").alias("is_drawdown_mean"), F.avg("oos_drawdown").alias("oos_drawdown_mean"),
        F.avg(diff).alias("sharpe_degradation"), F.stddev_samp(diff).alias("sharpe_degradation_std"), F.avg(rdiff).alias("return_degradation"),
        share(F.col("oos_return") > 0).alias("pct_oos_positive"), share(F.col("oos_sharpe") > F.col("is_sharpe")).alias("pct_oos_beats_is"),
        share(F.col("oos_sharpe") > 0).alias("oos_sharpe_positive_pct"),
    )


def rank(aggregated: DataFrame) -> DataFrame:
    """Configurations by composite score, with the out-of-sample winners flagged.

    Scores equal in ten digits are ties and rank by id: equivalent configurations differ in rounding noise only.
    The configurations are a bounded list, so one ordered partition holds them.
    """
    w = Window.orderBy(sig("composite_score", 10).desc(), "strategy_id")
    return aggregated.withColumns({"rank": F.row_number().over(w), "is_winner": F.coalesce(F.col("oos_active_return_mean") > 0, F.lit(False))})


def period_composite(periods: DataFrame) -> DataFrame:
    """Multi-period score: mean IR less half its population deviation, plus 0.5 when every period beats the benchmark.

    ``periods``: (strategy_id, period, active_return, information_ratio, evaluation_success).
    """
    ok = F.col("evaluation_success")
    ir = F.when(ok, F.col("information_ratio"))
    beats = F.bool_and(ok & (F.col("active_return") > 0) & (F.col("information_ratio") > 0))
    penalty = F.when(F.count(ir) > 1, 0.5 * F.stddev_pop(ir)).otherwise(0.0)
    score = F.avg(ir) - penalty + F.when(beats, 0.5).otherwise(0.0)
    return periods.groupBy("strategy_id").agg(
        beats.alias("beats_all_periods"), F.coalesce(score, F.lit(float("-inf"))).alias("composite_score")
    )


def trailing_score(returns: DataFrame, trailing_rows: int = 252, periods_per_year: float | str = 12.0) -> DataFrame:
    """Sharpe of the last rows, annualised by the schedule's periods, a number or a column that is constant in each
    strategy; fewer than 20 rows give minus infinity."""
    by = Window.partitionBy("strategy_id")
    r = returns.filter(F.col("r").isNotNull()).withColumn("_k", F.row_number().over(by.orderBy(F.col("date").desc())))
    t = r.filter(F.col("_k") <= trailing_rows).groupBy("strategy_id").agg(
        F.count("*").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"),
        (F.first(periods_per_year) if isinstance(periods_per_year, str) else F.lit(float(periods_per_year))).alias("ppy"))
    return t.select("strategy_id", "n", F.when(F.col("n") < 20, float("-inf")).otherwise(
        F.coalesce(ratio("m", "s") * F.sqrt("ppy"), F.lit(0.0))).alias("trailing_score"))


def regime_weighted_score(stats: DataFrame, weights: DataFrame, strategies: DataFrame) -> DataFrame:
    """Sharpe by regime averaged with regime shares as weights. ``weights``: (regime, share), one row per regime.

    ``strategies``: strategy_id of all that are ranked; one without a weighted regime gets minus infinity.
    """
    j = stats.join(bounded(weights, CONFIGS), "regime").filter((F.col("share") > 0) & F.col("sharpe_ratio").isNotNull())
    s = j.groupBy("strategy_id").agg(ratio(F.sum(F.col("share") * F.col("sharpe_ratio")), F.sum("share")).alias("regime_score"))
    return strategies.select("strategy_id").join(s, "strategy_id", "left").withColumn(
        "regime_score", F.coalesce("regime_score", F.lit(float("-inf"))))
