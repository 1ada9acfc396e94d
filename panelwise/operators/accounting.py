"""Portfolio value from weights, without a loop over dates.

Between two rebalances the value grows by the weighted growth of the assets, and a rebalance takes
a fraction that depends on target weights only. The factors are independent of the value itself, so
the value is a running product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelwise import CASH
from panelwise.functions.exprs import change, ratio
from panelwise.functions.joins import DAYS, bounded
from panelwise.operators.construction import paired
from panelwise.operators.metrics import active, performance


def forward_growth(scored: DataFrame, price: str = "price", keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Add ``growth``: price at the next decision date over price now, per ticker. Scores of ``signals.score``
    are already partitioned by ticker, so this adds no shuffle, also with a schedule as a further key."""
    w = Window.partitionBy(*keys).orderBy("as_of")
    return scored.withColumn("growth", ratio(F.lead(price).over(w), F.col(price)))


def periodic_value(
    weights: DataFrame, calendar: DataFrame, cost_bps: float = 10.0, capital: float = 100_000.0
) -> DataFrame:
    """(strategy_id, as_of, nav, cost, turnover, returns) at every rebalance.

    ``weights``: (strategy_id, as_of, ticker, weight, growth). Cash grows by 1; an instrument without a price
    at either end contributes nothing. The first trade, from cash, is charged like any other.
    """
    w = weights.withColumn("growth", F.when(F.col("ticker") == CASH, 1.0).otherwise(F.col("growth")))
    per = paired(w, calendar, carry_growth=True).groupBy("strategy_id", "as_of").agg(
        F.sum("grown").alias("gross"),
        (0.5 * F.sum(F.abs(F.col("next_w") - F.col("prev_w")))).alias("turnover"),
    )
    return compound(per.withColumn("cost_frac", F.col("turnover") * (cost_bps / 10_000.0)), capital)


def compound(factors: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """(strategy_id, as_of, gross, cost_frac[, turnover]) -> value curve."""
    by = Window.partitionBy("strategy_id").orderBy("as_of")
    net = F.col("gross") * (1.0 - F.col("cost_frac"))
    curve = factors.withColumn("nav", capital * F.product(net).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    paid = F.lag("nav").over(by)
    before = F.coalesce(paid, F.lit(capital)) * F.col("gross")
    return curve.withColumns({"cost": before * F.col("cost_frac"), "returns": change(F.col("nav"), paid)}).drop(
        "gross", "cost_frac"
    )


def holdings(weights: DataFrame, curve: DataFrame) -> DataFrame:
    """Shares and notional per position; cash is priced at 1."""
    px = F.when(F.col("ticker") == CASH, 1.0).otherwise(F.col("price"))
    j = weights.join(curve.select("strategy_id", "as_of", "nav"), ["strategy_id", "as_of"])
    return j.withColumn("notional", F.col("weight") * F.col("nav")).withColumn("shares", ratio(F.col("notional"), px))


def experiment_bundle(curve: DataFrame, benchmark: DataFrame, periods_per_year: float = 12.0) -> DataFrame:
    """One row per strategy: growth, risk and active metrics of its curve, rebalances and costs.

    ``curve``: (strategy_id, as_of, nav, cost, returns); ``benchmark``: (date, r). Both metric tables come from returns per (strategy,
    date); a strategy without a common date with the benchmark has NULL active metrics.
    """
    r = curve.select("strategy_id", F.col("as_of").alias("date"), F.col("returns").alias("r"))
    spent = curve.groupBy("strategy_id").agg(F.count("*").alias("num_rebalances"), F.sum("cost").alias("total_costs"))
    own = performance(r, periods_per_year).select(
        "strategy_id", "total_return", "cagr", "sharpe", "sortino", "max_drawdown", "volatility", "win_rate")
    beside = active(r, benchmark, periods_per_year).select("strategy_id", "active_return", "information_ratio", "tracking_error")
    return own.join(spent, "strategy_id").join(beside, "strategy_id", "left")


def run_summary(curve: DataFrame, capital: float = 100_000.0, periods_per_year: int = 12) -> DataFrame:
    """Total return, Sharpe, worst drawdown, costs and rebalance count per strategy."""
    by = Window.partitionBy("strategy_id").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    dd = curve.withColumn("dd", change(F.col("nav"), F.max("nav").over(by)))
    final = F.max_by("nav", "as_of")
    sharpe = ratio(F.avg("returns"), F.stddev_samp("returns")) * F.sqrt(F.lit(float(periods_per_year)))
    return dd.groupBy("strategy_id").agg(
        (final / capital - 1.0).alias("total_return"),
        F.coalesce(sharpe, F.lit(0.0)).alias("sharpe_ratio"),
        F.min("dd").alias("max_drawdown"),
        F.sum("cost").alias("total_costs"),
        F.count("*").alias("num_rebalances"),
        final.alias("final_nav"),
        F.lit(float(capital)).alias("initial_nav"),
    )


def portfolio_returns(positions: DataFrame, returns: DataFrame) -> DataFrame:
    """Sum of weight times return per (strategy_id, date); a position without a return that day adds 0."""
    j = positions.join(returns.select("date", "ticker", "r"), ["date", "ticker"], "left")
    return j.groupBy("strategy_id", "date").agg(F.sum(F.coalesce(F.col("weight") * F.col("r"), F.lit(0.0))).alias("r"))


def daily_positions(weights: DataFrame, calendar: DataFrame, end: str) -> DataFrame:
    """Daily weights: a target applies from the next business day through the next rebalance day (or ``end``).

    The holding interval is exploded into its days; the calendar is one row per rebalance, hence the broadcast.
    """
    from panelwise.functions.dates import next_bday

    cal = bounded(calendar.select("as_of", F.coalesce("next_as_of", F.lit(end).cast("date")).alias("until")), DAYS)
    lo, hi = next_bday("as_of"), F.col("until")
    days = F.when(lo <= hi, F.filter(F.sequence(lo, hi), lambda d: F.weekday(d) < 5))
    return weights.join(cal, "as_of").select("strategy_id", "ticker", "weight", "as_of", F.explode(days).alias("date"))


def daily_value(
    weights: DataFrame, returns: DataFrame, calendar: DataFrame, costs: DataFrame, start: str, end: str,
    initial: float = 1.0,
) -> DataFrame:
    """Daily curve on every business day of [start, end]; a rebalance's cost hits the business day after it.

    Days before the first position return 0. ``costs``: (strategy_id, as_of, cost).
    """
    from panelwise.functions.dates import next_bday, schedule_days

    pos = daily_positions(weights, calendar, end)
    port = portfolio_returns(pos, returns)
    charge = costs.select("strategy_id", next_bday("as_of").alias("date"), (-F.col("cost")).alias("r"))
    idle = weights.select("strategy_id").distinct().select(
        "strategy_id", F.explode(schedule_days(start, end, "daily")).alias("date"), F.lit(0.0).alias("r")
    )
    in_range = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    daily = idle.unionByName(port).unionByName(charge.filter(in_range)).groupBy("strategy_id", "date").agg(F.sum("r").alias("r"))
    by = Window.partitionBy("strategy_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    # The log curve stays finite where a long, volatile product leaves the range of a double.
    return daily.withColumns({
        "equity": initial * F.product(1.0 + F.col("r")).over(by),
        "log_equity": F.log(F.lit(initial)) + F.sum(F.log1p("r")).over(by),
    })


def buy_and_hold(prices: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """(strategy_id, as_of, price) -> value of a single purchase at the first price."""
    by = Window.partitionBy("strategy_id").orderBy("as_of")
    first = F.first("price", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    held = F.last("price", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    nav = capital * ratio(held, first)
    out = prices.withColumn("nav", nav).filter(F.col("nav").isNotNull())
    return out.withColumn("returns", change(F.col("nav"), F.lag("nav").over(by))).withColumn("cost", F.lit(0.0))
