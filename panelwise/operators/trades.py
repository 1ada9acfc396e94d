"""Trade lists, drift and pre-trade checks between two sets of weights or holdings.

Both sides are keyed by (strategy_id, as_of, ticker); one grouped sum replaces the full outer join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelwise.functions.exprs import ratio
from panelwise.functions.joins import DAYS, bounded

KEYS = ["strategy_id", "as_of", "ticker"]
CHECK_KEYS = ["strategy_id", "as_of"]


def align(current: DataFrame, target: DataFrame, fields: tuple[str, ...] = ("weight",)) -> DataFrame:
    """current_<f> and target_<f> per position, 0 where a side lacks it."""
    zero = F.lit(0.0)

    def side(df: DataFrame, cur: bool) -> DataFrame:
        return df.select(
            *KEYS,
            *[(F.coalesce(f, zero) if cur else zero).alias(f"current_{f}") for f in fields],
            *[(zero if cur else F.coalesce(f, zero)).alias(f"target_{f}") for f in fields],
        )

    both = side(current, True).unionByName(side(target, False))
    names = [f"{s}_{f}" for s in ("current", "target") for f in fields]
    return both.groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in names])


def consecutive(targets: DataFrame, calendar: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``align`` of every target with the one before it, in one pass.

    A target row is the target side of its own date and the current side of the next one; dates come from the
    calendar (as_of, next_as_of), one row per date.
    """
    cal = bounded(calendar.select("as_of", "next_as_of"), DAYS)
    zero = F.lit(0.0)

    def side(at: str, cur: bool):
        return F.struct(
            F.col(at).alias("at"), *[(F.coalesce(f, zero) if cur else zero).alias(f"current_{f}") for f in fields],
            *[(zero if cur else F.coalesce(f, zero)).alias(f"target_{f}") for f in fields],
        )

    both = targets.join(cal, "as_of").select("strategy_id", "ticker", F.inline(F.array(side("as_of", False), side("next_as_of", True))))
    names = [f"{s}_{f}" for s in ("current", "target") for f in fields]
    out = both.filter(F.col("at").isNotNull()).groupBy("strategy_id", "at", "ticker").agg(*[F.sum(n).alias(n) for n in names])
    return out.withColumnRenamed("at", "as_of")


def diff_trades(pairs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Weight changes; with a threshold only those at least that large."""
    out = pairs.withColumn("delta_weight", F.col("target_weight") - F.col("current_weight"))
    return out.filter(F.abs("delta_weight") >= threshold) if threshold > 0 else out


SHARE_FIELDS = ("shares", "weight", "price")


def share_trades(pairs: DataFrame) -> DataFrame:
    """BUY / SELL / HOLD with notional from pairs of ``SHARE_FIELDS``; the price is the target's, else the current one's."""
    delta = F.col("target_shares") - F.col("current_shares")
    price = F.when(F.col("target_price") != 0, F.col("target_price")).otherwise(F.col("current_price"))
    action = F.when(F.abs(delta) < 0.01, "HOLD").when(delta > 0, "BUY").otherwise("SELL")
    return pairs.withColumns({"action": action, "notional_value": F.abs(delta * price)}).drop("target_price", "current_price")


def drift(pairs: DataFrame, threshold: float = 0.02) -> DataFrame:
    d = F.col("target_weight") - F.col("current_weight")
    return pairs.withColumns({"drift": d, "abs_drift": F.abs(d)}).filter(F.col("abs_drift") >= threshold)


def check_turnover(trades: DataFrame, max_turnover: float) -> DataFrame:
    t = trades.groupBy(*CHECK_KEYS).agg((0.5 * F.sum(F.abs("delta_weight"))).alias("value"))
    return t.select(*CHECK_KEYS, F.lit("max_turnover").alias("check"), "value", (F.col("value") <= max_turnover).alias("passed"))


def check_sectors(trades: DataFrame, sectors: DataFrame, max_sector_weight: float = 0.40) -> DataFrame:
    """Largest sector share of the targets; unmapped tickers are 'Unknown'."""
    held = trades.filter(F.col("target_weight") > 0).join(sectors.select("ticker", "sector"), "ticker", "left")
    per = held.groupBy(*CHECK_KEYS, F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum("target_weight").alias("w"))
    worst = per.groupBy(*CHECK_KEYS).agg(F.max("w").alias("value"))
    return worst.select(
        *CHECK_KEYS, F.lit("sector_concentration").alias("check"), "value", (F.col("value") <= max_sector_weight).alias("passed")
    )


def check_small_trades(trades: DataFrame, min_trade_weight: float = 0.01) -> DataFrame:
    """Counts trades below the threshold; never blocks."""
    n = trades.groupBy(*CHECK_KEYS).agg(F.count_if(F.abs("delta_weight") < min_trade_weight).cast("double").alias("value"))
    return n.select(*CHECK_KEYS, F.lit("min_trade").alias("check"), "value", F.lit(True).alias("passed"))


def exposures_one_hot(reference: DataFrame, column: str, values: list[str]) -> DataFrame:
    """ticker x category indicator columns; the categories are configuration."""
    return reference.groupBy("ticker").agg(
        *[F.max(F.when(F.col(column) == v, 1.0).otherwise(0.0)).alias(v) for v in values]
    )


def exposures_long(reference: DataFrame, column: str) -> DataFrame:
    """(ticker, category, exposure) of 1 where a ticker is in a category; absent pairs are 0. Any number of categories."""
    return reference.select("ticker", F.coalesce(F.col(column), F.lit("Unknown")).alias("category"), F.lit(1.0).alias("exposure")).distinct()


def to_shares(weights: DataFrame, portfolio_value: float) -> DataFrame:
    notional = F.col("weight") * portfolio_value
    return weights.withColumn("notional", notional).withColumn("shares", ratio("notional", "price"))
